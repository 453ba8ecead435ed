"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised apart. From any boundary on, a
pre-tokenisation depends only on what follows, so two chunks that share a boundary in their overlap agree from there: the
text is stitched at the first such boundary, and the pieces between stitches are encoded apart. Decoding joins raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import ship, text_or_empty, written

#: Code points of a chunk and of its overlap with each neighbour.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Near the end of a cut chunk a contraction may be cut short; starts of matches this close to it are not trusted.
CUT = 4


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def _starts(text: str, pattern: str, base: int, whole: bool) -> np.ndarray:
    """Where pre-tokens start, in code points of the whole text."""
    found = np.fromiter((m.start() for m in _matcher(pattern).finditer(text)), dtype=np.int64)
    return base + (found if whole else found[found < len(text) - CUT])


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Of each chunk, the starts of pre-tokens in its overlaps with the chunks before and after."""

    def of(batches):
        for b in batches:
            heads, tails = [], []
            for text, k, base, last in zip(b["piece"].to_pylist(), b["k"].to_pylist(), b["base"].to_pylist(), b["last"].to_pylist(), strict=True):
                starts = _starts(text, pattern, base, last)
                near = lambda at: starts[(starts >= at - overlap) & (starts < at + overlap)].tolist()  # noqa: B023, E731
                heads.append(near(k * chunk) if k else [])
                tails.append([] if last else near((k + 1) * chunk))
            yield pa.RecordBatch.from_arrays([b["blob"], b["k"], b["size"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["blob", "k", "size", "head", "tail"])

    return of


def _stitch(table: pa.Table) -> pa.Table:
    """The pieces of one text: cuts at the first boundary that neighbours share; from the first pair that shares none, the
    rest of the text is one piece."""
    rows = sorted(zip(table["k"].to_pylist(), table["head"].to_pylist(), table["tail"].to_pylist(), strict=True))
    cuts = [0]
    for (_, _, tail), (_, head, _) in zip(rows, rows[1:], strict=False):
        shared = sorted({x for x in tail if x > cuts[-1]} & set(head))
        if not shared:
            break
        cuts.append(shared[0])
    ends = [*cuts[1:], table["size"][0].as_py()]
    n = len(cuts)
    return pa.table({"blob": pa.array([table["blob"][0].as_py()] * n, pa.binary()), "j": pa.array(range(n), pa.int32()), "start": pa.array(cuts, pa.int64()), "end": pa.array(ends, pa.int64())})


def _encode(ranks, pattern: str, keep: tuple[str, ...], text: str, digest: bool):
    """Columns ``keep`` as they are, then the ids' count and, as digests or raw, ids and decoded bytes."""

    def of(batches):
        encoding = _encoding(ranks.value, pattern)
        for b in batches:
            n, ids, raw = [], [], []
            for t in b[text].to_pylist():
                got = encoding.encode_ordinary(t)
                n.append(len(got))
                ids.append(np.array(got, dtype="<u4").tobytes())
                raw.append(encoding.decode_bytes(got))
            if digest:
                shas = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, raw)]
                last = [pa.array(shas[0]), pa.array(shas[1]), pa.array(ids, pa.binary())]
                names = ["ids_sha256", "decoded_sha256", "ids"]
            else:
                last, names = [pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["ids", "raw"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(n, pa.int64()), *last], [*keep, "n_tokens", *names])

    return of


def _joined(table: pa.Table) -> pa.Table:
    """One text's pieces in order, as one encoding."""
    order = np.argsort(table["j"].to_numpy())
    ids, raw = (b"".join(table[c][int(i)].as_py() for i in order) for c in ("ids", "raw"))
    return pa.table({
        "blob": pa.array([table["blob"][0].as_py()], pa.binary()), "n_tokens": pa.array([len(ids) // 4], pa.int64()),
        "ids_sha256": [hashlib.sha256(ids).hexdigest()], "decoded_sha256": [hashlib.sha256(raw).hexdigest()], "ids": pa.array([ids], pa.binary()),
    })


def _long(texts: DataFrame, ranks, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(blob, n_tokens, ids_sha256, decoded_sha256, ids) of distinct long ``texts`` (blob, text)."""
    size = F.length("text")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")),
        lambda k: F.struct(
            k.alias("k"),
            F.greatest(k * chunk - overlap, F.lit(0)).alias("base"),
            F.substring(F.col("text"), F.greatest(k * chunk - overlap, F.lit(0)) + 1, (k + 1) * chunk + overlap - F.greatest(k * chunk - overlap, F.lit(0))).alias("piece"),
            ((k + 1) * chunk + overlap >= size).alias("last"),
        ),
    )
    chunks = texts.select("blob", size.cast("long").alias("size"), F.explode(cut).alias("c")).select("blob", "size", "c.*")
    found = chunks.mapInArrow(_boundaries(pattern, chunk, overlap), "blob binary, k int, size long, head array<long>, tail array<long>")
    pieces = found.groupBy("blob").applyInArrow(_stitch, "blob binary, j int, start long, end long")
    parts = pieces.join(texts, "blob").select("blob", "j", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("text"))
    coded = parts.mapInArrow(_encode(ranks, pattern, ("blob", "j"), "text", False), "blob binary, j int, n_tokens long, ids binary, raw binary")
    return coded.groupBy("blob").applyInArrow(_joined, "blob binary, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """Encode every whole text by the ranks in the file ``path``, then decode: id, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, if asked for, ``ids`` (little-endian unsigned 32-bit integers).

    A null text is the empty one, of no tokens; repeated rows keep theirs; an empty table gives no rows. Texts of at most a
    chunk are encoded where they are read; only longer ones are shuffled, each distinct one once.
    """
    ship(docs.sparkSession)
    if chunk <= 2 * overlap:
        raise ValueError("a chunk must be longer than its two overlaps")
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    out = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"))
    short = rows.filter(F.length("text") <= chunk).mapInArrow(_encode(ranks, pattern, ("__id",), "text", True), f"__id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    large = rows.filter(F.length("text") > chunk).withColumn("blob", F.unhex(F.sha2("text", 256)))
    texts = written(large.select("blob", "text").dropDuplicates(["blob"]))
    coded = _long(texts, ranks, pattern, chunk, overlap)
    return short.select(F.col("__id").alias(id_col), *out).unionByName(large.select("__id", "blob").join(coded, "blob").select(F.col("__id").alias(id_col), *out))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """(row, raw): every row of ``tokens`` whole, as one struct that no name of its can clash with, and the bytes of the ids in
    ``ids_col`` (little-endian unsigned 32-bit integers), concatenated.

    Null ids stay null, no ids are no bytes; an id without a rank raises; repeated rows are decoded each. Each task looks tokens up in one table of bytes and
    offsets, all ids of a batch at once; nothing is shuffled.
    """
    ship(tokens.sparkSession)
    with open(path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    rows = tokens.select(F.struct(*(F.col(f"`{c}`") for c in tokens.columns)).alias("row"), F.col(ids_col).alias("ids"))

    def of(batches):
        data, starts, sizes = _token_bytes(shared.value)
        for b in batches:
            raw = []
            for packed in b["ids"].to_pylist():
                ids = np.frombuffer(packed or b"", "<u4").astype(np.int64)
                if len(ids) and (ids.max() >= len(sizes) or sizes[ids].min() == 0):
                    raise ValueError("an id that no token has")
                n = sizes[ids]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                raw.append(None if packed is None else data[np.repeat(starts[ids], n) + inner].tobytes())
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(raw, pa.binary())], ["row", "raw"])

    return rows.mapInArrow(of, StructType([rows.schema["row"], StructField("raw", BinaryType())]))


@lru_cache(maxsize=4)
def _token_bytes(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and where each id's start and how many they are (0: no such id)."""
    table = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(table, default=-1) + 1, np.int64)
    for i, token in table.items():
        sizes[i] = len(token)
    return np.frombuffer(b"".join(table[i] for i in sorted(table)), np.uint8), np.cumsum(sizes) - sizes, sizes
