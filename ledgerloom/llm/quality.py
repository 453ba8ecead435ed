"""Quality rules: a threshold table compiled into one projection over native columns, with no user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "a", "and", "are", "be", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with",
    "au", "dans", "de", "des", "du", "est", "et", "la", "le", "les", "pour", "que", "qui", "un", "une",
    "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu",
    "como", "con", "del", "el", "en", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; an end that is None is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table of the registered query.
RULES = (
    Rule("n_words", 20, None),
    Rule("repeat_ratio", None, 0.30),
    Rule("mean_word_chars", 2, 25),
    Rule("symbol_ratio", None, 0.10),
    Rule("dup_line_ratio", None, 0.50),
    Rule("stop_ratio", 0.01, None),
)


def _repeated_words(w: Column) -> Column:
    """Words in windows of eight that occur twice or more. Windows are compared by hash, within one text; only a text with a
    repeated window pays for a sort, after which equal neighbours in (hash, place) order are the repeats."""

    def among(s: Column) -> Column:
        same = lambda x, k: F.coalesce((k >= 0) & (F.get(s, k)["h"] == x["h"]), F.lit(False))
        at = F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    # Hashes of 2, 4 and 8 words from those of 1, 2 and 4: each word is hashed once.
    doubled = lambda h, by: F.transform(F.slice(h, 1, F.size(h) - by), lambda x, i: F.xxhash64(x, F.get(h, i + by)))
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(doubled(h, 1), lambda h: let(doubled(h, 2), lambda h: doubled(h, 4))))
    placed = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(w) >= WINDOW, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed(h), among)).otherwise(0))).otherwise(0)


def _verdict(m: Column, rules: tuple[Rule, ...]) -> Column:
    """The struct of a text's counts and what the threshold table says of them."""
    per = lambda a, b: F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0))
    metrics = {
        "n_words": m["n_words"], "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "stop_ratio": per("n_stops", "n_words"),
    }
    broken = []
    for rule in rules:
        x = metrics[rule.metric]
        out = F.lit(False)
        out = out | (x < rule.low) if rule.low is not None else out
        out = out | (x > rule.high) if rule.high is not None else out
        broken.append(F.when(out, F.lit(rule.metric)))
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return let(F.array_compact(F.array(*broken)), lambda failed: F.struct(*counts, base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed")))


def report(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Everything about one text as one struct: one expression, in which each part is worked out once."""

    def counts(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stops"),
        )

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: let(lines, lambda x: let(counts(w, x), lambda m: _verdict(m, rules))))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure and judge every row: counts, ``base_failed``, ``kept`` and the names of failed rules, comma-joined (``failed``).

    A null or empty text has no words, so it fails; repeated rows are judged alike; an empty table gives no rows. One
    projection after the scan: no shuffle, nothing leaves the JVM.
    """
    rows = docs.select(F.col(id_col), report(text_or_empty(text_col), rules).alias("__report"))
    return rows.select(id_col, "__report.*")
