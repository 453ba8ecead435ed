"""Benchmark decontamination by a positional inverted index.

Postings (term, document, position) of every benchmark term are stored once, each with a one-byte signature of the word that
follows. Each 13-word window of an item is looked up by the term of it that is rarest in the corpus; its postings with the
right follower, shifted by the term's place in the item, are alignments of item and document. The postings of the other terms
are intersected at the same shift, and runs of consecutive places at least a window long are exact occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, text_of_id, text_or_empty, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A side of a join is broadcast up to this many rows of a few dozen bytes, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def words_of(text_col: str):
    return F.array_remove(F.split(ascii_lower(text_or_empty(text_col)), GAPS), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def document_key(id_col: str, text_col: str):
    """Two columns that name a row by its id and text; repeated rows share them and so their result."""
    return F.xxhash64(text_of_id(id_col)).alias("k1"), F.xxhash64(text_or_empty(text_col), F.lit(1)).alias("k2")


def test_terms(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_key, item_id, n, place, term): the benchmark's words; equal rows of the benchmark count once."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(text_col).alias("w")).withColumn("item_key", F.xxhash64("item_id", "w")).dropDuplicates(["item_key"])
    return items.select("item_key", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("place", "term"))


def _signature(word):
    return (F.pmod(F.xxhash64(word), F.lit(256)) - 128).cast("byte")


#: Stands behind the last word of every document; no word holds a space.
END, END_ID = " ", 0


def build_postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: (term_id, k1, k2, pos, follower) of every occurrence of a term of ``terms`` (term, term_id), and of
    the mark ``END_ID`` at each document's end, whose position is the count of its words."""
    k1, k2 = document_key(id_col, text_col)
    marked = docs.select(k1, k2, F.concat(words_of(text_col), F.array(F.lit(END))).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("term"), F.slice("w", 2, F.size("w")).alias("next"))
    tokens = marked.select("k1", "k2", F.posexplode(pairs).alias("pos", "x")).select("k1", "k2", "pos", "x.term", "x.next")
    terms = terms.select("term", "term_id").unionByName(terms.sparkSession.createDataFrame([(END, END_ID)], "term string, term_id long"))
    return written(tokens.join(_small(terms), "term").select("term_id", "k1", "k2", "pos", _signature("next").alias("follower")))


def leads(tests: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_key, place, term_id, follower): of each window of each item the term that is rarest among those with a follower
    in the window (or of all, null follower, in an item of one word); windows with a term the corpus lacks go. Of equal windows
    of an item one is looked up: it is found wherever the others are, so a word repeated a thousand times is one window."""
    counted = tests.join(frequency, "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("item_key").orderBy("place")
    span = F.least(F.lit(window), F.col("n"))
    best = (
        counted.withColumn("follower", F.lead("signature").over(ahead))
        .withColumn("least", F.min("df").over(ahead.rowsBetween(0, window - 1)))
        .withColumn("lead", F.min(F.struct("df", "place", "term_id", "follower")).over(ahead.rowsBetween(0, max(0, window - 2))))
        .withColumn("words", F.xxhash64(F.collect_list("term_id").over(ahead.rowsBetween(0, window - 1))))
        .filter((F.col("place") <= F.col("n") - span) & (F.col("least") > 0))
    )
    best = best.groupBy("item_key", "words").agg(F.min_by("lead", "place").alias("lead"))
    return best.select("item_key", "lead.place", "lead.term_id", "lead.follower").distinct()


def occurrences(postings: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every maximal exact match of at least one window: (k1, k2, item_id, start, end), word positions, ends exclusive."""
    frequency = postings.groupBy("term_id").agg(F.count("*").alias("df"))
    lead = _small(written(leads(tests, frequency, window)))
    follows = lead["follower"].isNull() | (lead["follower"] == postings["follower"])
    aligned = postings.join(lead, (postings["term_id"] == lead["term_id"]) & follows).select("k1", "k2", "item_key", (F.col("pos") - F.col("place")).alias("shift")).distinct()
    aligned = written(aligned)
    near = postings.join(_small(aligned.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").drop("follower")
    wanted = aligned.join(_small(tests), "item_key").select("k1", "k2", "item_key", "item_id", "shift", "n", "place", "term_id", (F.col("shift") + F.col("place")).alias("pos"))
    met = wanted.join(near, ["k1", "k2", "pos", "term_id"]).groupBy("k1", "k2", "item_key", "shift").agg(F.array_sort(F.collect_set("place")).alias("places"), F.max("n").alias("n"), F.max("item_id").alias("item_id"))
    runs = met.select("k1", "k2", "item_key", "shift", "item_id", "n", F.explode(F.transform("places", lambda p, i: F.struct((p - i).alias("run"), p.alias("place")))).alias("x"))
    runs = runs.groupBy("k1", "k2", "item_key", "shift", "x.run").agg(F.min("x.place").alias("a"), F.max("x.place").alias("b"), F.max("n").alias("n"), F.max("item_id").alias("item_id"))
    long_enough = F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n"))
    return runs.filter(long_enough).select("k1", "k2", "item_id", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b") + 1).alias("end"))


def near_occurrences(postings: DataFrame, first: int, second: int, distance: int) -> DataFrame:
    """Proximity from the same index: documents and positions where two terms lie within ``distance`` words.

    Positions are cut in blocks of ``distance``; a pair lies in one block or in neighbours, so the join is an equi-join.
    """
    a = postings.filter(F.col("term_id") == first).select("k1", "k2", F.col("pos").alias("a"), F.explode(F.array(*(F.floor(F.col("pos") / distance) + i for i in (-1, 0, 1)))).alias("block"))
    b = postings.filter(F.col("term_id") == second).select("k1", "k2", F.col("pos").alias("b"), F.floor(F.col("pos") / distance).alias("block"))
    return a.join(b, ["k1", "k2", "block"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("a") - F.col("b")) <= distance)).select("k1", "k2", "a", "b")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per distinct (id, text) of ``docs``: k1, k2, n_words, n_hit, items, contaminated."""
    tests = test_terms(benchmark, item_col, "text")
    terms = written(tests.select("term").distinct().withColumn("term_id", F.xxhash64("term")))
    tests = written(tests.join(terms, "term").select("item_key", "item_id", "n", "place", "term_id", _signature("term").alias("signature")))
    postings = build_postings(docs, terms, id_col, text_col)
    found = written(occurrences(postings, tests, window))
    before = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    hits = found.select("k1", "k2", "start", "end").distinct().withColumn("reach", F.max("end").over(before)).groupBy("k1", "k2").agg(F.sum(new).cast("long").alias("n_hit"))
    items = found.select("k1", "k2", F.coalesce("item_id", F.lit("")).alias("i")).distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("i")).alias("items"))
    ends = postings.filter(F.col("term_id") == END_ID).groupBy("k1", "k2").agg(F.max("pos").cast("long").alias("n_words"))
    rows = ends.join(hits.join(items, ["k1", "k2"]), ["k1", "k2"], "left").select("k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return written(rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Judge every document against the benchmark: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    Contaminated: a hit, and hit words are at least a twentieth of the words. Null and empty texts have no words; an item
    of fewer words than a window is one window, one of none has none; items of a null id count as one named ''. Repeated
    rows are judged alike; an empty table on either side gives no rows, or rows without hits.
    """
    k1, k2 = document_key(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), k1, k2).join(judge(docs, benchmark, window, id_col, text_col, item_col), ["k1", "k2"])
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without its contaminated rows; judged as in ``decontaminate``: null and empty texts stay, repeated rows stay or go
    together, an empty benchmark takes nothing and an empty table gives no rows. The user's columns travel in one struct, so none
    of their names can clash."""
    k1, k2 = document_key(id_col, text_col)
    bad = written(judge(docs, benchmark, window, id_col, text_col, item_col).filter("contaminated").select("k1", "k2"))
    rows = docs.select(k1, k2, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(bad, ["k1", "k2"], "left_anti").select("row.*")
