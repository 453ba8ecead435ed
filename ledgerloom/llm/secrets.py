"""Secret scans over an incremental blob ledger.

Every text is a blob addressed by its SHA-256. The ledger is a stored table of blobs, one folder a version of the rules. Only
blobs that it lacks at the current version are scanned, once each however many rows hold them, and added to it; findings go
back to all rows by a join on the address.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; one whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Patterns of secrets, in the order that breaks ties between spans. Long-enough runs need no later check
#: where the match is one maximal run.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
#: A private key from its header to the END line that closes it, or the header alone where none follows before another run
#: of five hyphens. Possessive, so that a body of any length takes one pass and no stack.
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"
#: What is scanned for: ``RULES`` with whole private keys.
WHOLE_RULES = tuple(replace(r, pattern=KEY_BLOCK) if r.kind == "private_key" else r for r in RULES)
#: The same matches for the DuckDB twin, whose RE2 is linear without possessive forms and looks nowhere ahead: hyphens of a body
#: come one to four at a time.
TWIN_RULES = tuple(replace(r, pattern=r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]{0,30}PRIVATE KEY-----)?") if r.kind == "private_key" else r for r in RULES)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, spans {SPAN}, version string"


def version_of(rules: tuple[Rule, ...]) -> str:
    """The name of a set of rules: another rule is another version, and every blob is unseen at it."""
    return "v2-" + hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def ledger_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at ``path``, one folder a version; None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _hits(text: Column, rank: int, rule: Rule) -> Column:
    """Lengths of each match, of the gap before it and of the checked group. Splitting at a pattern and extracting it see
    the same matches, so gaps and matches alternate."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    found = F.transform(
        F.arrays_zip(matches.alias("m"), groups.alias("g"), F.split(text, rule.pattern, -1).alias("gap")),
        lambda x: F.struct(F.lit(rank).alias("rank"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["g"]) >= rule.least).alias("ok")),
    )
    return F.when(text.rlike(rule.pattern), F.filter(found, lambda x: x["len"].isNotNull()))


def address(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = WHOLE_RULES, text_col: str = "text") -> DataFrame:
    """Ledger entries (``blob``, ``spans``, ``version``) of the blobs in ``docs`` that ``ledger`` lacks at the version of
    ``rules``.

    Spans count code points, ends exclusive, in order of start and then of the rules. A null text is the empty blob; repeated
    rows are one blob; an empty table gives no entries.
    """
    version = version_of(rules)
    blobs = docs.select(address(text_col).alias("blob"), text_or_empty(text_col).alias("__text")).dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    empty = F.array().cast("array<struct<rank:int,gap:int,len:int,ok:boolean>>")
    hits = F.concat(*(F.coalesce(_hits(F.col("__text"), i, r), empty) for i, r in enumerate(rules)))
    rows = blobs.select("blob", F.posexplode_outer(hits).alias("__at", "__hit")).select("blob", "__at", "__hit.*")
    upto = Window.partitionBy("blob", "rank").orderBy("__at")
    rows = rows.withColumn("__end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("int"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    span = F.when(F.col("ok"), F.struct((F.col("__end") - F.col("len")).alias("start"), "rank", F.element_at(kinds, F.col("rank") + 1).alias("kind"), F.col("__end").alias("end")))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans")).select("blob", "spans", F.lit(version).alias("version"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_findings(docs: DataFrame, rules: tuple[Rule, ...] = WHOLE_RULES, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """(row, spans): every row of ``docs`` whole, as one struct that no name of its can clash with, and its spans (null where
    there are none).

    With the path ``ledger`` only blobs that the table there lacks at the version of ``rules`` are scanned, and their entries
    are added to it; a run that fails leaves it as it was. Every row that holds a blob, old or new, gets its findings.
    """
    spark = docs.sparkSession
    known = ledger_of(spark, ledger) if ledger else None
    new = scan(docs, known, rules, text_col)
    if ledger:
        new.write.mode("append").option("compression", "zstd").partitionBy("version").parquet(ledger)
        entries = ledger_of(spark, ledger)
    else:
        entries = written(new)
    # Two runs at once may both add a blob: its entries are equal.
    found = entries.filter((F.col("version") == version_of(rules)) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), address(text_col).alias("blob"))
    return rows.join(found, "blob", "left").select("row", "spans")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = WHOLE_RULES, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """Secrets of every whole text: counts and digest of the base kinds, and all spans as ``kind:start:end``.

    A null or empty text has none; repeated rows and copies share one scan and keep their own rows; an empty table gives
    no rows. ``ledger``: as in ``with_findings``.
    """
    rows = with_findings(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rules, "text", ledger)
    spans = F.coalesce("spans", F.array().cast(SPAN))
    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("row.id", spans.alias("s")).select(
        F.col("id").alias(id_col), *map(count, base), F.sha2(_joined(F.filter("s", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = WHOLE_RULES, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans become one, named by the first. A null text stays
    null and an empty one empty; repeated rows stay and agree; an empty table gives no rows. ``ledger``: as in
    ``with_findings``."""
    text = F.col("row").getField(text_col)

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        new = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, F.concat(a["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.col("spans").isNotNull(), clean).otherwise(text)
    rows = with_findings(docs, rules, text_col, ledger)
    return rows.select(*((masked if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
