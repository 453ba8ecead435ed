"""SimHash near-duplicates by vantage-point trees.

Two 64-bit fingerprints within 3 bits agree in one of their 32-bit halves up to 1 bit. For each half a multiway
vantage-point tree branches at every node on the Hamming distance to that node's vantage point, a half of the data's own;
leaves are shards. By the triangle inequality a half within 1 bit lies, at every node, on a branch at most 1 away, and flipping
one bit changes every distance by exactly 1: so a fingerprint meets all its partners in its own leaf and in the leaves reached
by +1 or -1 at every node. There full fingerprints are compared, and links are followed to components.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import components

from .common import let, ship, text_of_id, text_or_empty, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a leaf, about, that the depth of the trees aims at; and most members compared in one block of pairs.
LEAF, BLOCK = 48, 4096
#: Rows that one group of leaves holds, about.
GROUP = 60_000
BROADCAST_ROWS = 500_000
#: Points that the nodes of a level choose from, and fingerprints that points are chosen among.
POINTS, SAMPLE = 8, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    ones, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    while hashes := [digest(whole[a:b], SEED) for a, b in itertools.islice(pairs, 1 << 16)]:
        ones += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        found = np.array([fingerprint(t) for t in b["text"].to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["__id"], pa.array(found)], ["__id", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, fp): a fingerprint for every row, as a signed long; 0 where there is no word."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, f"__id {kind}, fp long")


def vantage_points(fps: DataFrame, depth: int) -> list[list[list[int]]]:
    """Of each half, for each level, the points that its nodes choose from: halves of fingerprints at hand, from a bounded sample
    (the ``SAMPLE`` first by hash), each far from all that were chosen before it."""
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()] or [0], np.int64).view(np.uint64)
    out = []
    for half in (0, 1):
        rest = np.unique(sample >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF))
        chosen, off = [], np.full(len(rest), 64)
        for i in range(depth * POINTS):
            # Once all halves are taken, their rotations: any word will do as a point.
            x = int(rest[off.argmax()]) if off.max() > 0 else (chosen[i - len(rest)] << 7 | chosen[i - len(rest)] >> 25) & 0xFFFFFFFF
            chosen.append(x)
            off = np.minimum(off, np.bitwise_count(rest ^ np.uint64(x)))
        # Neighbours in the order of choice are the farthest apart: a level takes every depth-th.
        out.append([chosen[k::depth] for k in range(depth)])
    return out


def leaves(fps: DataFrame, points: list[list[list[int]]]) -> DataFrame:
    """(half, leaf, fp, own): the leaf where each half lives and those that it visits.

    A node's name is the way to it, which also says which of its level's points is its own. A partner one bit off lies on the
    branch one up or one down at the root and, wherever it is, on a branch one up or down from there: so a half follows both at
    every node below. At the root it follows the upper only, for the partner below follows its upper to here."""
    parts = []
    for half, levels in enumerate(points):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(0xFFFFFFFF)

        def child(node, level, to, bits=bits, levels=levels):
            of = F.element_at(F.array(*(F.lit(x).cast("long") for x in levels[level])), (F.pmod(F.xxhash64(node), F.lit(len(levels[level]))) + 1).cast("int"))
            return node * 35 + F.bit_count(bits.bitwiseXOR(of)) + 1 + to

        root = F.lit(0).cast("long")
        own, visits = child(root, 0, 0), F.array(child(root, 0, 1))
        for k in range(1, len(levels)):
            own = let(own, lambda p: child(p, k, 0))  # noqa: B023
            visits = F.flatten(F.transform(visits, lambda p: F.array(child(p, k, -1), child(p, k, 1))))  # noqa: B023
        parts.append(fps.select(F.lit(half).alias("half"), "fp", F.posexplode(F.concat(F.array(own), visits)).alias("move", "leaf")).select("half", "leaf", "fp", (F.col("move") == 0).alias("own")))
    return parts[0].unionByName(parts[1])


def _components(bits: np.ndarray, own: int, block: np.ndarray, cross: bool) -> np.ndarray:
    """For each member of a leaf the first member it is linked to, through links of the leaf. The first ``own`` members live
    there; two visitors are no link, they meet elsewhere."""
    label = np.arange(len(bits))
    for a in range(0, own, 512):
        b = min(own, a + 512)
        near = np.bitwise_count(bits[a:b, None] ^ bits[None, :]) <= RADIUS
        if cross:
            near &= block[a:b, None] != block[None, :]
        near[np.arange(b - a), np.arange(a, b)] = False
        for i in np.flatnonzero(near.any(1)):
            met = np.unique(np.append(label[near[i]], label[a + i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def _links(table: pa.Table) -> pa.Table:
    """Links (a, b) that span the components inside each leaf (or each pair of blocks of a large one) of a group."""
    half, leaf, i, j, block = (table[c].to_numpy() for c in ("half", "leaf", "i", "j", "block"))
    fp, own = table["fp"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
    order = np.lexsort((fp, ~own, j, i, leaf, half))
    half, leaf, i, j, block, fp, own = (x[order] for x in (half, leaf, i, j, block, fp, own))
    new = np.flatnonzero(np.concatenate(([True], (np.diff(half) != 0) | (np.diff(leaf) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))))
    found = [np.zeros((2, 0), np.int64)]
    for s, e in zip(new, [*new[1:], len(fp)], strict=True):
        if e - s > 1 and own[s:e].any():
            label = _components(fp[s:e].view(np.uint64), int(own[s:e].sum()), block[s:e], i[s] != j[s])
            moved = np.flatnonzero(label != np.arange(e - s))
            found.append(np.stack([fp[s + moved], fp[s + label[moved]]]))
    a, b = np.concatenate(found, axis=1)
    return pa.table({"a": a, "b": b})


def links(fps: DataFrame, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fps`` (fp) that connect exactly what lies within 3 bits, step by step."""
    ship(fps.sparkSession)
    n = fps.count()
    depth = min(10, max(1, math.ceil(math.log(max(n / leaf, 1.001), 10))))
    rows = leaves(fps, vantage_points(fps, depth))
    # A leaf with more members than a block is compared block against block, each pair of blocks apart.
    large = written(rows.groupBy("half", "leaf").agg(F.count("*").alias("n"), F.max("own").alias("met")).filter((F.col("n") > block) & F.col("met")).select("half", "leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    large = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    rows = rows.join(large, ["half", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("half", "leaf", "fp", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    groups = max(1, math.ceil(2 * n * (1 + 2 ** (depth - 1)) / GROUP))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("half", "leaf", "i", "j"), F.lit(groups)))
    return rows.groupBy("part").applyInArrow(_links, "a long, b long").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of ``rows`` (__id, fp): the smallest id of the component of each fingerprint."""
    firsts = written(rows.groupBy("fp").agg(F.min("__id").alias("first")))
    roots = components(links(firsts.select("fp")))
    joined = written(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(joined.join(least, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group near-duplicates: id, ``fingerprint`` (16 lowercase hex digits), ``component_id``.

    A null or empty text has fingerprint 0 and is linked like any other. Null ids are passed over in ``component_id``, null
    only where a component has no other; repeated rows agree; an empty table gives no rows. Equal fingerprints are one node,
    so groups of copies cost nothing after the first aggregation.
    """
    rows = written(with_fingerprints(docs, id_col, text_col))
    return rows.join(classes(rows), "fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the first by id (nulls first), then by a digest of id and text.

    Null and empty texts, and all without a word, have fingerprint 0 and are one group with what is near it; repeated rows are
    one row, which of them where other columns differ is open; an empty table gives no rows. The user's columns travel in one
    struct, so none of their names can clash."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.unhex(F.sha2(F.concat_ws("\0", text_of_id(id_col), text_or_empty(text_col)), 256))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("__id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(_fingerprints, f"__id struct<id:{kind},digest:binary>, fp long"))
    keep = written(classes(rows).select("component_id.digest").distinct())
    # The join and the removal of repeated rows hash on the same column: the texts move once.
    whole = docs.select(digest.alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return whole.join(keep, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")
