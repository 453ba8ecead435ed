"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to ``ORDER`` long holds symbol counts. A symbol is coded by the longest known
context; one not seen there escapes to the next shorter context, with the symbols seen so far excluded, and at last to a
uniform code. Counts are frozen after training, so the code length of a symbol depends on the context alone: each tree
becomes one table of bits by (context, byte) and one of next contexts, and a text is scored by walking them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import ship, text_of_id

ORDER = 4
#: Bytes of labelled text that training looks at, per language: as many at least, or all there are, and a few hundredths more.
SAMPLE_BYTES = 400_000
#: Texts are drawn in pieces of this many bytes, so that no long text is a language's whole sample.
DRAWN = 1024
#: Steps of the drawing bound for each halving of the sample.
STEPS = 32
#: Contexts kept over all languages, the most frequent first; besides them each language keeps a quarter as many of its own
#: most frequent ones, whatever the others hold. Bounds the tables that tasks get.
MAX_CONTEXTS = 4096
#: Languages learned, those with the most labelled bytes first; labels beyond them are not learned.
MAX_LANGUAGES = 256
#: Bytes of all tables that tasks get: beyond some twenty languages fewer contexts are kept of each.
MODEL_BYTES = 256_000_000
#: A text is walked in pieces of this many bytes, all pieces of a batch abreast; a piece warms up on the bytes before it.
PIECE = 256
#: Rows that go back to Spark at once.
ROWS_BACK = 1024
UNKNOWN = "und"


@dataclass(frozen=True)
class Tree:
    """``bits[context, symbol]``, ``after[context, symbol]``: where the next context's row starts; context 0 is the empty one."""

    symbol: np.ndarray
    bits: np.ndarray
    after: np.ndarray


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    trees: tuple[Tree, ...]
    order: int

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for t in self.trees for x in (t.symbol, t.bits, t.after))


def held_out(id_col: str):
    return (F.crc32(F.encode(text_of_id(id_col), "UTF-8")) % 4) == 2


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and the offsets of its texts; a null has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _grams(order: int):
    """(lang, size, gram, n): counts of every context of up to ``order`` bytes with the byte after it, packed in a long."""

    def of(batches):
        for b in batches:
            data, offsets = _bytes_of(b["text"])
            langs = np.array(b["lang"].to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for size in range(order + 1):
                    found = []
                    for i in np.flatnonzero(langs == lang):
                        x = data[offsets[i] : offsets[i + 1]].astype(np.int64)
                        if len(x) > size:
                            found.append(sum(x[k : len(x) - size + k] << 8 * (size - k) for k in range(size + 1)))
                    if found:
                        gram, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), size, np.int32)), pa.array(gram), pa.array(n)], ["lang", "size", "gram", "n"])

    return of


def _tree(rows, order: int) -> Tree:
    """``rows``: columns size, context, symbol, n of a language's kept contexts, as arrays."""
    size, context, sym, n = rows
    names = sorted({(int(s), int(c)) for s, c in zip(size, context, strict=True)})
    if not names or names[0] != (0, 0):
        names.insert(0, (0, 0))
    place = {x: i for i, x in enumerate(names)}
    seen = np.unique(sym)
    symbol = np.full(256, len(seen), dtype=np.int32)
    symbol[seen] = np.arange(len(seen))
    states, width = len(names), len(seen) + 1
    counts = np.zeros((states, len(seen)))
    at = np.array([place[int(s), int(c)] for s, c in zip(size, context, strict=True)], dtype=np.int64)
    np.add.at(counts, (at, symbol[sym]), n)
    shorter = np.array([place[s - 1, c & ((1 << 8 * (s - 1)) - 1)] if s else 0 for s, c in names])
    sizes = np.array([s for s, _ in names])
    bits = np.zeros((states, width), dtype=np.float32)
    after = np.zeros((states, width), dtype=np.int32)
    for d in range(order + 1):
        own = np.flatnonzero(sizes == d)
        now, done, escape, p = own, np.zeros((len(own), len(seen)), bool), np.ones(len(own)), np.zeros((len(own), len(seen)))
        for _ in range(d + 1):
            c = np.where(done, 0, counts[now])
            total, kinds = c.sum(1), (c > 0).sum(1)
            p += np.where(c > 0, (escape / np.maximum(total + kinds, 1))[:, None] * c, 0)
            escape = np.where(total > 0, escape * kinds / np.maximum(total + kinds, 1), escape)
            done |= c > 0
            now = shorter[now]
        left = 256 - done.sum(1)
        scale = np.where(left == 0, 1 - escape, 1.0)
        rest = escape / np.maximum(left, 1)
        p = np.where(done, p / scale[:, None], rest[:, None])
        bits[own, : len(seen)] = -np.log2(p)
        bits[own, len(seen)] = -np.log2(np.maximum(rest, 1e-300))
        # A context one byte longer where it is kept, else where the next shorter context goes.
        if d:
            after[own] = after[shorter[own]]
        for i in np.flatnonzero(sizes == d + 1):
            before = place.get((d, names[i][1] >> 8))
            if before is not None:
                after[before, symbol[names[i][1] & 255]] = i * width
    return Tree(symbol, bits, after)


def _step(h: Column, i: Column) -> Column:
    """The step at which a piece is drawn: n or more for a share of 2^(-n / STEPS) of all."""
    return F.floor(F.log2((F.shiftrightunsigned(F.xxhash64(h, i), 11) + 1) / F.lit(float(1 << 53))) * -STEPS).cast("int")


def _drawn(rows: DataFrame, sample_bytes: int) -> tuple[tuple[str, ...], DataFrame | None]:
    """The languages of ``rows`` (id, lang, text), and pieces (lang, text) of each: the bytes at every step are counted first,
    so that the steps taken hold ``sample_bytes`` or all there is. Rows that repeat whole count once. Of more than
    ``MAX_LANGUAGES`` languages those with the most bytes are taken, of equals the first by name."""
    rows = rows.select("lang", F.xxhash64(text_of_id("id"), "text").alias("h"), F.octet_length("text").alias("n"), F.col("text").cast("binary").alias("text"))
    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / DRAWN).cast("int"))
    every = rows.select("lang", "h", "n").distinct().select("lang", "h", "n", F.explode(pieces).alias("i"))
    steps = every.groupBy("lang", _step(F.col("h"), F.col("i")).alias("step")).agg(F.sum(F.least(F.lit(DRAWN), F.col("n") - F.col("i") * DRAWN)).alias("n"))
    totals = steps.groupBy("lang").agg(F.collect_list(F.struct("step", "n")).alias("steps"), F.sum("n").alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(MAX_LANGUAGES).collect()
    if not totals:
        return (), None
    least = {}
    for r in totals:
        have = 0
        for step, n in sorted(r["steps"], reverse=True):
            if have < sample_bytes:
                have, least[r["lang"]] = have + n, step
    bound = F.element_at(F.map_from_arrays(F.array(*map(F.lit, least)), F.array(*map(F.lit, least.values()))), F.col("lang"))
    taken = rows.filter(F.col("lang").isin(*least)).select("lang", "h", "text", F.explode(F.filter(pieces, lambda i: _step(F.col("h"), i) >= bound)).alias("i"))
    return tuple(sorted(least)), taken.select("lang", "h", "i", F.substring("text", F.col("i") * DRAWN + 1, F.lit(DRAWN)).alias("text")).dropDuplicates(["lang", "h", "i"]).select("lang", "text")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES, max_contexts: int = MAX_CONTEXTS) -> Model | None:
    """Frozen statistics of the languages of ``labelled``, from about ``sample_bytes`` of each; None without any.

    Rows with a null label, or a null or empty text, teach nothing; repeated rows teach once. Of equally frequent contexts the
    shorter, then the first by bytes is kept. The model is at most ``MODEL_BYTES``, whatever the number of languages."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text != ''")
    languages, sample = _drawn(rows, sample_bytes)
    if sample is None:
        return None
    # A language's table has a row of up to 257 symbols, of 8 bytes each, a context; it keeps 5/4 of the contexts at most.
    max_contexts = min(max_contexts, MODEL_BYTES // (8 * 257 * len(languages)) * 4 // 5)
    grams = sample.mapInArrow(_grams(order), "lang string, size int, gram long, n long")
    grams = grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).select("lang", "size", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("symbol"), "n").cache()
    sums = grams.groupBy("lang", "size", "context").agg(F.sum("n").alias("own"))
    kept = sums.groupBy("size", "context").agg(F.sum("own").alias("all")).orderBy(F.desc("all"), "size", "context").limit(max_contexts)
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("own"), "size", "context"))
    own = sums.withColumn("best", best).filter(F.col("best") <= max_contexts // 4).select("lang", "size", "context")
    names = sums.join(F.broadcast(kept.select("size", "context")), ["size", "context"]).select("lang", "size", "context").unionByName(own).distinct()
    out = grams.join(names, ["lang", "size", "context"]).select("lang", "size", "context", "symbol", "n").toPandas()
    grams.unpersist()
    trees = dict(tuple(out.groupby("lang")))
    return Model(languages, tuple(_tree([trees[x][c].to_numpy() for c in ("size", "context", "symbol", "n")], order) for x in languages), order)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language: (texts, languages)."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][owner] + inner * PIECE
    length = np.minimum(PIECE, sizes[owner] - inner * PIECE)
    order = np.argsort(-length, kind="stable")
    owner, inner, start, length = owner[order], inner[order], start[order], length[order]
    warm = np.flatnonzero(inner > 0)
    ends = np.searchsorted(-length, -np.arange(1, PIECE + 1), side="right")
    out = np.zeros((len(sizes), len(model.trees)))
    for j, tree in enumerate(model.trees):
        # Symbols are looked up as they are needed: those of a whole batch take four times its bytes, twice while they change.
        after, bits, symbol = tree.after.ravel(), tree.bits.ravel(), tree.symbol
        state = np.zeros(len(owner), dtype=np.int32)
        for t in range(model.order):
            state[warm] = after[state[warm] + symbol[data[start[warm] - model.order + t]]]
        total = np.zeros(len(owner))
        for t, k in enumerate(ends):
            if not k:
                break
            at = state[:k] + symbol[data[start[:k] + t]]
            total[:k] += bits[at]
            state[:k] = after[at]
        out[:, j] = np.bincount(owner, weights=total, minlength=len(sizes))
    return out


def _predict(shared, at: int | None):
    """``at``: which of the row's columns is the text, where it is not a column beside it."""

    def of(batches):
        model: Model = shared.value
        names = np.array(model.languages, dtype=object)
        for b in batches:
            bits = code_lengths(model, *_bytes_of(b["text"] if at is None else b["row"].field(at)))
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits[np.arange(len(bits)), best][:, None] - bits, -1000)).sum(1)
            known = np.array(b["known"].to_pylist(), dtype=bool)
            out = [pa.array(np.where(known, names[best], UNKNOWN).tolist(), pa.string()), pa.array(np.where(known, share, 0.0))]
            found = pa.RecordBatch.from_arrays([b["row"], *out], ["row", "lang_pred", "score"])
            for i in range(0, len(found), ROWS_BACK):
                yield found.slice(i, ROWS_BACK)

    return of


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): every row of ``docs`` whole, as one struct that no name of its can clash with, and what its whole
    text says.

    The score is the language's share of the probability that all of them give the text. A null text, one without a letter,
    and any text where no language was learned are ``und`` with score 0; ties go to the first name; repeated rows agree; an
    empty table gives no rows. No shuffle.
    """
    text = F.col(text_col).cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # A text that the row holds goes to the task once.
    held = docs.schema[text_col].dataType == StringType()
    return _walked(docs.select(row, *[text.alias("text")] * (not held), _known(text)), model, docs.columns.index(text_col) if held else None)


def _known(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known")


def _walked(rows: DataFrame, model: Model | None, at: int | None) -> DataFrame:
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_predict(shared, at), schema)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict every row: id, ``held_out``, ``lang_pred``, ``score``. A null id counts as the empty string in ``held_out``;
    repeated rows agree; an empty table gives no rows."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), held_out(id_col).alias("held_out")).alias("row"), text.alias("text"), _known(text))
    return _walked(rows, model, None).select(F.col("row.id").alias(id_col), "row.held_out", "lang_pred", "score")


def learned(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out; None where none of them has a label and a text, as in an empty table."""
    return train(docs.filter(~held_out("doc_id")))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all; nulls and odd rows as ``train`` and ``identify`` say."""
    return identify(docs, learned(docs))


def with_language(docs: DataFrame) -> DataFrame:
    """(row, lang_pred, score) of every row of ``docs``, learned alike; nulls and odd rows as ``predict`` says."""
    return predict(docs, learned(docs))
