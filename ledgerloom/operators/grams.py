"""What texts that are alike are joined by: their rare grams, or letters of theirs that are the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ledgerloom.sources.ship import ship

#: Grams are counted by hash; a bucket's count only orders them, so which texts meet does not depend on it.
BITS = 16
BUCKETS = 1 << BITS
#: Bits of a gram's number below its bucket's rank, and how many letters are looked at abreast.
LOW, CELLS = 63 - BITS, 1 << 20


def abreast(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of texts of much the same length, as many at once as ``CELLS`` letters hold."""
    order = np.argsort(lengths, kind="stable")
    while len(order):
        n = max(1, int(np.searchsorted(np.arange(1, len(order) + 1) * lengths[order], CELLS, side="right")))
        yield order[:n]
        order = order[n:]


def letters(texts: list[str], width: int) -> np.ndarray:
    """A row a text, a column a letter; 0 behind the last."""
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros((len(codes), codes.shape[1] - q + 1), np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, j : j + h.shape[1]]
    return _mixed(h)


def _read(texts: list[str], q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, letters, lengths) of texts, letters in rows of at least ``q``."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for at in abreast(lengths):
        yield at, letters([texts[i] for i in at], max(int(lengths[at[-1]]), q)).astype(np.uint64), lengths[at]


def _odd(codes: np.ndarray, lengths: np.ndarray, q: int) -> np.ndarray:
    """Which of 64 kinds of grams of ``q`` letters a text has an odd number of. A letter put in or left out changes at most 2 q - 1
    kinds, one put for another 2 q."""
    kind = codes & np.uint64(63) if q == 1 else _grams(codes, q) >> np.uint64(58)
    bit = np.where(np.arange(kind.shape[1]) < (lengths - q + 1)[:, None], np.uint64(1) << kind, np.uint64(0))
    return np.bitwise_xor.reduce(bit, axis=1).view(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def counted(texts: DataFrame, q: int) -> np.ndarray:
    """The place of each bucket, from that whose grams are rarest in ``texts`` (s) to the most common."""

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for x in batches:
            for _, codes, lengths in _read(x.column("s").to_pylist(), q):
                h, size = _grams(codes, q), np.maximum(lengths - q + 1, 1)
                n += np.bincount(_bucket(h)[np.arange(h.shape[1]) < size[:, None]], minlength=BUCKETS)
        b = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n[b])], names=["b", "n"])

    ship(texts.sparkSession)
    # At most a row a bucket comes back.
    found = texts.select("s").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    n, ranks = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.uint64)
    n[found["b"].to_numpy()] = found["n"].to_numpy()
    ranks[np.argsort(n, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def _with_keys(texts: DataFrame, keys, q: int, odd: tuple[int, ...], *more: Column) -> DataFrame:
    """``texts`` (s, ...) with a row for each of the numbers (``gram``) that ``keys`` (letters, lengths, ``more``) makes of them, and for
    each of ``odd`` its kinds of grams of that many letters (``odd1``, ...)."""
    columns, extra, kinds = texts.columns, [f"__{i}" for i in range(len(more))], [f"odd{n}" for n in odd]

    def made(batches):
        for x in batches:
            given = [x.column(c).to_numpy() for c in extra]
            for at, codes, lengths in _read(x.column("s").to_pylist(), max(q, *odd)):
                key, own = keys(codes, lengths, *(g[at] for g in given))
                ends = np.concatenate([[0], own.sum(axis=1).cumsum()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[own].astype(np.int64)))
                rows = x.select(columns).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(_odd(codes, lengths, n)) for n in odd), lists], names=[*columns, *kinds, "grams"])

    ship(texts.sparkSession)
    schema = StructType([*texts.schema.fields, *(StructField(k, LongType()) for k in kinds), StructField("grams", ArrayType(LongType()))])
    out = texts.select(*columns, *(c.cast("int").alias(name) for c, name in zip(more, extra, strict=True))).mapInArrow(made, schema)
    return out.select(*columns, *kinds, F.explode("grams").alias("gram"))


def rarest(texts: DataFrame, ranks: np.ndarray, q: int, kept: Column, odd: tuple[int, ...] = (1,)) -> DataFrame:
    """``texts`` (s, ...) with a row for each of its ``kept`` rarest grams (``gram``, a number that goes by rank and hash). Grams that
    come again are counted again, and equal numbers are one row: of two texts that must share a gram, the first they share is
    among both's. Two grams of one number only let more texts meet."""

    def keys(codes, lengths, most):
        h, size = _grams(codes[:, : max(int(lengths.max()), q)], q), np.maximum(lengths - q + 1, 1)
        place = np.arange(h.shape[1])
        key = np.where(place < size[:, None], ranks[_bucket(h)] << np.uint64(LOW) | h & np.uint64((1 << LOW) - 1), np.uint64(2**64 - 1))
        key.sort(axis=1)
        own = place < np.minimum(size, most)[:, None]
        own[:, 1:] &= key[:, 1:] != key[:, :-1]
        return key, own

    return _with_keys(texts, keys, q, odd, kept)


def letters_by_kind(texts: DataFrame, least: Column, most: Column) -> DataFrame:
    """``texts`` (s, ...) with, for each d from ``least`` to ``most``, a row for the letters of each of d + 1 kinds (``gram``, a number),
    in whatever order. Of texts that d insertions and deletions apart one kind has the same letters."""

    def keys(codes, lengths, least, most):
        top = int(most.max(initial=0))
        weight = np.where(codes > 0, _mixed(codes + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
        key = [_mixed(np.where(codes % np.uint64(d + 1) == i, weight, np.uint64(0)).sum(axis=1, dtype=np.uint64) + np.uint64(64 * d + i)) >> np.uint64(1) for d in range(top + 1) for i in range(d + 1)]
        asked = np.array([d for d in range(top + 1) for _ in range(d + 1)])
        return np.stack(key, axis=1), (asked >= least[:, None]) & (asked <= most[:, None])

    return _with_keys(texts, keys, 1, (1,), least, most)


def differ(a: Column, b: Column) -> Column:
    """In how many kinds two texts' ``odd`` differ."""
    return F.bit_count(a.bitwiseXOR(b))
