"""Names that mean the same: precedence of names, longest prefixes, misread letters, word order."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import ocr_fold, search_key
from ledgerloom.operators import grams
from ledgerloom.sources.scratch import written
from ledgerloom.sources.ship import ship

#: Letters and digits that a reader takes for one another.
LOOK_ALIKE = ("O0QD", "I1L", "S5", "B8", "Z2", "G6")
LOOK_COST = 0.3


def resolve(names: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``names`` (name) with the ``target`` of the best ``known`` (name, target, precedence): one a folded name."""
    fold = F.lower(F.trim("name"))
    best = known.withColumn("fold", fold).groupBy("fold").agg(F.min_by("target", F.struct("precedence", "target")).alias("target"))
    return names.withColumn("fold", fold).join(best, "fold", "left").drop("fold")


def longest_prefix(rows: DataFrame, claims: DataFrame, longest: int) -> DataFrame:
    """Each row's (text) longest claim (prefix) that it starts with: prefixes meet by length, so the join is on equality."""
    cut = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(longest)))).alias("__n")).withColumn("prefix", F.substring(F.col("text"), F.lit(1), F.col("__n")))
    met = cut.join(claims.select("prefix").distinct(), "prefix")
    best = met.groupBy("row_id").agg(F.max_by("prefix", "__n").alias("claim"))
    return rows.join(best, "row_id", "left")


def misread_cost(a: str, b: str, most: float) -> float:
    """Weighted edit distance: look-alikes 0.3, any other edit 1, an edit of a digit impossible; inf beyond ``most``.

    Cheapest-first search over pairs of prefixes: with a small ``most`` it visits little more than the diagonal.
    """
    group = {c: g for g in LOOK_ALIKE for c in g}
    edit = lambda *chars: math.inf if any(c.isdigit() for c in chars) else 1.0
    done: set[tuple[int, int]] = set()
    open_ = [(0.0, 0, 0)]
    while open_:
        cost, i, j = heapq.heappop(open_)
        if (i, j) == (len(a), len(b)):
            return cost
        if (i, j) in done:
            continue
        done.add((i, j))
        steps = []
        if i < len(a) and j < len(b):
            alike = 0.0 if a[i] == b[j] else LOOK_COST if b[j] in group.get(a[i], "") else edit(a[i], b[j])
            steps.append((cost + alike, i + 1, j + 1))
        if i < len(a):
            steps.append((cost + edit(a[i]), i + 1, j))
        if j < len(b):
            steps.append((cost + edit(b[j]), i, j + 1))
        for step in steps:
            if step[0] <= most:
                heapq.heappush(open_, step)
    return math.inf


#: What a name may cost, by the length of its fold: under six letters look-alikes alone, else one edit and one
#: more for every fifteen letters.
SHORT, SHORT_BUDGET, LETTERS_AN_EDIT = 6, 0.9, 15


def budget(folded: str) -> float:
    return SHORT_BUDGET if len(folded) < SHORT else 1 + len(folded) // LETTERS_AN_EDIT


def priced(a: list[str], b: list[str]) -> np.ndarray:
    """``misread_cost`` of each pair of folds within the budget of the first, pairs of a budget abreast: an edit that is no look-alike
    costs 1, so of the table of prefixes only what lies within the budget of its diagonal is worked out."""
    out = np.full(len(a), np.inf)
    budgets, length = np.array([budget(x) for x in a]), np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for most in np.unique(budgets):
        ours = np.flatnonzero(budgets == most)
        for some in grams.abreast(length[ours]):
            at = ours[some]
            out[at] = _priced([a[i] for i in at], [b[i] for i in at], float(most))
    return out


def _priced(a: list[str], b: list[str], most: float) -> np.ndarray:
    group, fixed = np.zeros(128, np.int8), np.zeros(128, bool)
    for i, g in enumerate(LOOK_ALIKE):
        group[[ord(c) for c in g]] = i + 1
    # No edit reaches behind the end of a name.
    fixed[[0, *map(ord, "0123456789")]] = True
    off = int(most)
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    width = int(n.max(initial=0)) + 1
    p, q = (np.minimum(grams.letters(x, w).T, 127) for x, w in ((a, width), (b, max(width + off, int(m.max(initial=0)) + 1))))
    gp, gq, drop, add = group[p], group[q], np.where(fixed[p], np.inf, 1.0), np.where(fixed[q], np.inf, 1.0)
    cost, out = np.full((2 * off + 1, len(a)), np.inf), np.full(len(a), np.inf)
    for i in range(width):
        new = np.full_like(cost, np.inf)
        for o in range(2 * off + 1):
            j = i + o - off
            if j < 0:
                continue
            x = np.zeros(len(a)) if i == j == 0 else new[o]
            if i and j:
                k, l = i - 1, j - 1
                swap = np.where(p[k] == q[l], 0.0, np.where((gp[k] > 0) & (gp[k] == gq[l]), LOOK_COST, np.maximum(drop[k], add[l])))
                x = np.minimum(x, cost[o] + swap)
            if i and o < 2 * off:
                x = np.minimum(x, cost[o + 1] + drop[i - 1])
            if j and o:
                x = np.minimum(x, new[o - 1] + add[j - 1])
            new[o] = np.where(x <= most, x, np.inf)
            done = (n == i) & (m == j)
            out[done] = new[o][done]
        cost = new
    return out


def _edits(length: Column) -> Column:
    """Whole edits that a fold of this length may cost."""
    return F.when(length < SHORT, 0).otherwise(1 + F.floor(length / LETTERS_AN_EDIT)).cast("int")


def _pieces(length: Column, edits: Column, f) -> Column:
    """``f(i, start, size)`` of each of the ``edits`` + 1 pieces, as even as can be, of a string of ``length``."""
    at = lambda i: F.floor(length * i / (edits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), edits), lambda i: f(i, at(i), at(i + 1) - at(i)))


#: Folds of fewer letters meet by pieces, others by their rarest grams of ``GRAM`` letters.
LONG, GRAM = 12, 4


def misread_match(read: DataFrame, known: DataFrame) -> DataFrame:
    """(read_id, known_id, cost): the one known name of the same supplier that a misread name can be, cheaper than the next by
    at least half an edit."""
    return sure_of(misread_costs(read, known))


def sure_of(priced: DataFrame) -> DataFrame:
    """Of ``priced`` (read_id, known_id, cost; the least of a pair counts) the cheapest of each name, where the next costs half an
    edit more."""
    w = Window.partitionBy("read_id").orderBy("cost", "known_id")
    one = priced.groupBy("read_id", "known_id").agg(F.min("cost").alias("cost"))
    best = one.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("cost").over(w)).filter("r = 1")
    return best.filter(F.col("next").isNull() | (F.col("next") - F.col("cost") >= 0.5)).select("read_id", "known_id", "cost")


def misread_costs(read: DataFrame, known: DataFrame) -> DataFrame:
    """(read_id, known_id, cost): every known name of the same supplier within a misread name's budget, with what it costs.

    Look-alikes are made equal first, and the digits that look like nothing else must be the same. A known name within k edits
    of a long one shares one of the ``GRAM`` k + 1 rarest grams of either, as an edit spoils ``GRAM`` of them. A short name is cut in k + 1 pieces, of
    which the name read holds one whole, at most k places off. Both are equi-joins that find every pair within the budget. Edit
    distance without weights (at most k) thins them out before they are priced.
    """
    s, n = F.col("s"), F.length("s")
    row = lambda df, id_, fold: df.select("supplier_id", F.col("id").alias(id_), ocr_fold(F.col("name")).alias(fold)).withColumn("s", F.translate(fold, "0QD1L5826", "OOOIISBZG")).withColumn("digits", F.regexp_replace("s", "[^3479]", ""))
    a, b = written(row(read, "read_id", "a")), written(row(known, "known_id", "b"))
    k, a = _edits(n), a.withColumn("__k", _edits(n))
    met = lambda a, b, *keys: a.withColumnRenamed("s", "sa").hint("merge").join(b.withColumnRenamed("s", "sb"), [*keys, "supplier_id", "digits"])
    near = lambda met, apart: met.filter(apart & (F.call_function("levenshtein", F.col("sa"), F.col("sb"), F.col("__k")) >= 0)).select("read_id", "known_id", "a", "b")

    # A known name can be asked for by names somewhat longer or shorter, whose budget is another.
    around = F.sequence(F.greatest(_edits(n) - 1 - F.floor(_edits(n) / LETTERS_AN_EDIT).cast("int"), F.lit(0)), _edits(n) + 1 + F.floor(_edits(n) / LETTERS_AN_EDIT).cast("int"))
    key = lambda k, size, i, text: F.struct(k.cast("int").alias("k"), size.cast("int").alias("n"), i.cast("int").alias("i"), text.alias("piece"))
    keys_known = F.flatten(F.transform(around, lambda k: _pieces(n, k, lambda i, at, size: key(k, n, i, F.substring(s, at + 1, size)))))
    moved = lambda m, i, at, size: F.transform(F.sequence(F.greatest(-k, -at), k), lambda d: key(k, m, i, F.substring(s, at + d + 1, size)))
    keys_read = F.flatten(F.transform(F.sequence(F.greatest(n - k, F.lit(0)), n + k), lambda m: F.flatten(_pieces(m, k, lambda i, at, size: moved(m, i, at, size)))))
    # One edit is the most of a name of fewer than ``LONG`` letters.
    short = near(met(a.filter(n < LONG).withColumn("key", F.explode(F.array_distinct(keys_read))), b.filter(n <= LONG).withColumn("key", F.explode(F.array_distinct(keys_known))), "key"), F.lit(True))

    a, b = a.filter(n >= LONG), b.filter(n >= LONG - 1)
    counts = grams.counted(a.select("s").unionByName(b.select("s")), GRAM)
    # A name of n <= m + k letters may ask with k edits, k <= 1 + n / 15: k <= (m + 15) / 14.
    most = F.floor((n + LETTERS_AN_EDIT) / (LETTERS_AN_EDIT - 1))
    side = lambda df, kept, to: grams.rarest(df, counts, GRAM, kept, (1, 2)).withColumnsRenamed({"odd1": f"__{to}1", "odd2": f"__{to}2"})
    # An edit changes at most two letters and four pairs of letters.
    apart = (grams.differ(F.col("__a2"), F.col("__b2")) <= 4 * F.col("__k")) & (grams.differ(F.col("__a1"), F.col("__b1")) <= 2 * F.col("__k"))
    long_ = near(met(side(a, GRAM * k + 1, "a"), side(b, GRAM * most + 1, "b"), "gram"), apart)
    pairs = short.unionByName(long_).distinct()

    def price(batches):
        for x in batches:
            yield x.assign(cost=priced(x.a.tolist(), x.b.tolist()))[["read_id", "known_id", "cost"]]

    ship(read.sparkSession)
    # A known one may have several names: the nearest counts.
    return pairs.mapInPandas(price, "read_id long, known_id long, cost double").filter("cost < double('infinity')").groupBy("read_id", "known_id").agg(F.min("cost").alias("cost"))


def same_words(names: DataFrame) -> DataFrame:
    """(key, n, first_id): names that have the same words in any order and the same numbers."""
    words = F.array_join(F.array_sort(F.regexp_extract_all(F.upper("name"), F.lit(r"[A-Z0-9]+"), F.lit(0))), " ")
    return names.groupBy(words.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


#: How short a word may stand for a longer one, and how long one is that may have a typo.
SHORTEST, TYPO = 3, 7


def _alike(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    if a == b or (len(short) >= SHORTEST and long.startswith(short)):
        return True
    if len(short) < TYPO or len(long) - len(short) > 1 or not (a.isalpha() and b.isalpha()):
        return False
    head = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[head + (len(short) == len(long)) :] == long[head + 1 :]


def _plural(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= SHORTEST and long == short + "S")


def _all_paired(a: list[str], b: list[str], alike) -> bool:
    """Whether each word of ``a`` has a partner of its own in ``b``: a word that finds its partners taken asks them to move."""
    holder: dict[int, int] = {}

    def seat(i: int, asked: set[int]) -> bool:
        for j in range(len(b)):
            if j not in asked and alike(a[i], b[j]):
                asked.add(j)
                if j not in holder or seat(holder[j], asked):
                    holder[j] = i
                    return True
        return False

    return all(seat(i, set()) for i in range(len(a)))


def paired(names: DataFrame) -> DataFrame:
    """(a_id, b_id, sure): names of one group that say the same words, each word of one paired with its own of the other: equal,
    short for it, or one typo apart; ``sure`` where equal or plural alone is enough. ``names``: id, grp, name; equal sets of
    words are one name, of the smallest id.

    Words that are alike share their first three letters, or their last four, or are equal. Each name is looked up by these
    keys of its rarest word, among all words of the others with as many.
    """
    listed = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(search_key(F.col("name"))), F.lit(r"[A-Z0-9]+"), F.lit(0))))
    each = names.select("id", "grp", listed.alias("words")).filter("size(words) > 0").groupBy("grp", "words").agg(F.min("id").alias("id"))
    keys = lambda w: F.filter(F.array(F.when(F.length(w) < SHORTEST, F.concat(F.lit("="), w)).otherwise(F.concat(F.lit("<"), F.substring(w, 1, SHORTEST))), F.when(F.length(w) >= TYPO, F.concat(F.lit(">"), F.right(w, F.lit(TYPO - SHORTEST))))), lambda k: k.isNotNull())
    said = each.select("grp", "id", "words", F.size("words").alias("n"), F.explode("words").alias("word")).withColumn("key", F.explode(keys(F.col("word"))))
    common = said.groupBy("grp", "n", "key").agg(F.count("*").alias("often"))
    rare = said.join(common, ["grp", "n", "key"]).groupBy("grp", "n", "id", "words", "word").agg(F.sum("often").alias("often"), F.collect_set("key").alias("keys"))
    asks = rare.groupBy("grp", "n", "id", "words").agg(F.min_by("keys", F.struct("often", "word")).alias("keys")).select("grp", "n", F.col("id").alias("a"), F.col("words").alias("wa"), F.explode("keys").alias("key"))
    met = asks.join(said.select("grp", "n", F.col("id").alias("b"), F.col("words").alias("wb"), "key"), ["grp", "n", "key"]).filter("a <> b")
    first = F.col("a") < F.col("b")
    pairs = met.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), F.when(first, F.col("wa")).otherwise(F.col("wb")).alias("wa"), F.when(first, F.col("wb")).otherwise(F.col("wa")).alias("wb")).distinct()

    def decide(batches):
        for x in batches:
            same = [_all_paired(list(p), list(q), _alike) for p, q in zip(x.wa, x.wb, strict=True)]
            x = x[same]
            yield x.assign(sure=[_all_paired(list(p), list(q), _plural) for p, q in zip(x.wa, x.wb, strict=True)])[["a_id", "b_id", "sure"]]

    ship(names.sparkSession)
    return pairs.mapInPandas(decide, "a_id long, b_id long, sure boolean")
