"""Removal of repeated 200-byte strings by suffix arrays.

Every 200-byte window of a text has an anchor: the least hash among its 32-byte strings, the leftmost of equals. Equal windows
have equal anchors, so only stretches whose anchor occurs twice or more are looked at further. Such a stretch (the windows of
one anchor, about 270 bytes) goes to the shard of its anchor; each shard sorts the suffixes of its stretches by induced
sorting, measures common prefixes of neighbours in text order, and a window is repeated if its run of neighbours with 200
common bytes holds another. The repeated windows go back to their texts, which lose the bytes that these cover.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of_id, text_or_empty, written

WINDOW, GRAM = 200, 32
#: Bytes of stretches in a shard, about.
SHARD = 6_000_000
#: An anchor with more occurrences has its stretches cut into single windows, which go to the shard of their own content.
HOT = 20_000
FIXED = np.uint64(0x9E3779B97F4A7C15)


# ---- induced sorting -------------------------------------------------------------------------------------------------


def _rank_by_doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of a reduced string most of whose names are already unique: the end of the recursion. A rank is the first
    place of its group; each round sorts only the members of groups of several."""
    n, h = len(s), 1
    order = np.argsort(s)
    sorted_ = s[order]
    rank = np.empty(n, np.int64)
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.append(first[1:], True)
    at = np.flatnonzero(~alone)
    while len(at):
        members = order[at]
        after = np.where(members + h < n, rank[np.minimum(members + h, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + after
        o = np.argsort(key)
        members, key = members[o], key[o]
        order[at] = members
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[members] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~(first & np.append(first[1:], True))]
        h *= 2
    return order


def _induce(s: np.ndarray, small: np.ndarray, size: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the LMS suffixes ``lms`` in order: buckets ascending for the larger-type suffixes, then
    descending for the smaller-type ones. Inside a bucket the suffixes that it induces itself come in waves."""
    n, k = len(s), len(size)
    end = np.cumsum(size)
    head = end - size
    sa = np.full(n, -1, np.int64)
    order = np.argsort(s[lms], kind="stable")
    first = s[lms][order].astype(np.int64)
    count = np.bincount(first, minlength=k)
    tail = end - count
    sa[tail[first] + np.arange(len(first)) - (np.cumsum(count) - count)[first]] = lms[order]

    def put(found: np.ndarray, at: np.ndarray, step: int) -> None:
        chars = s[found]
        o = np.argsort(chars, kind="stable")
        c = chars[o].astype(np.int64)
        m = np.bincount(c, minlength=k)
        place = np.arange(len(c)) - (np.cumsum(m) - m)[c]
        sa[at[c] + place if step > 0 else at[c] - 1 - place] = found[o]
        at += step * m

    used = np.flatnonzero(size)
    at = head.copy()
    for c in used:
        lo = head[c]
        while lo < at[c]:
            found = sa[lo : at[c]] - 1
            lo = at[c]
            put(found[(found >= 0) & ~small[found]], at, 1)
        if count[c]:
            found = sa[tail[c] : end[c]] - 1
            put(found[(found >= 0) & ~small[found]], at, 1)
    at = end.copy()
    large_end = end - np.bincount(s[small], minlength=k)
    for c in used[::-1]:
        hi = end[c]
        while hi > at[c]:
            found = sa[at[c] : hi][::-1] - 1
            hi = at[c]
            put(found[(found >= 0) & small[found]], at, -1)
        found = sa[head[c] : large_end[c]][::-1] - 1
        put(found[(found >= 0) & small[found]], at, -1)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting of ``s``, integers over 0 that end with the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # Narrow characters sort by counting.
    s = s.astype(np.uint16) if int(s.max()) < 1 << 16 else s.astype(np.int64)
    kind = np.append((s[1:] > s[:-1]).astype(np.int8) - (s[1:] < s[:-1]), np.int8(1))
    # An equal neighbour has the type of the next suffix that differs.
    where = np.where(kind != 0, np.arange(n), n - 1)
    small = kind[np.minimum.accumulate(where[::-1])[::-1]] > 0
    size = np.bincount(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(s, small, size, lms)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_piece = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = by_piece[:-1], by_piece[1:]
    differs = length[a] != length[b]
    open_, t = np.flatnonzero(~differs), 0
    while len(open_):
        far = s[a[open_] + t] != s[b[open_] + t]
        differs[open_[far]] = True
        t += 1
        open_ = open_[~far]
        open_ = open_[length[a[open_]] > t]
    name = np.zeros(n, np.int64)
    name[by_piece] = np.concatenate(([0], np.cumsum(differs)))
    reduced = name[lms]
    names = int(reduced.max()) + 1
    if names == len(lms):
        order = np.argsort(reduced)
    elif names < len(lms) // 64:
        order = suffix_array(reduced)
    else:
        order = _rank_by_doubling(reduced)
    return _induce(s, small, size, lms[order])


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffixes a and b of at least ``known``, in whole words of 8 bytes, up to ``cap``."""
    out = known // 8 * 8
    go = np.flatnonzero(out < cap)
    while len(go):
        same = words[a[go] + out[go]] == words[b[go] + out[go]]
        go = go[same]
        out[go] += 8
        go = go[out[go] < cap]
    return out


def repeated_in(sa: np.ndarray, data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each place but the first in ``sa``: whether its suffix and the one before share ``window`` bytes.

    Prefixes are measured permuted, in text order: one that is so long at a place is at most 1 shorter at the next, so every
    16th is measured and the others are measured only from what that leaves open.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(window + 48, np.uint8)])
    words = np.ndarray((n + window + 32,), "<u8", padded.tobytes(), strides=(1,))
    have = before >= 0
    step = 16
    first = np.flatnonzero(have[::step]) * step
    long = np.zeros(-(-n // step) * step, np.int64)
    long[first] = _common(words, first, before[first], np.zeros(len(first), np.int64), window + step)
    floor = np.maximum(np.repeat(long[::step], step)[:n] - np.arange(n) % step, 0)
    rest = np.flatnonzero(have & (floor < window))
    got = floor.copy()
    got[rest] = _common(words, rest, before[rest], floor[rest], window)
    return got[sa[1:]] >= window


# ---- anchors ---------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * FIXED)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, count of windows) of each stretch of one text."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    power = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * power(_BASE)[:n])))
    h = _mixed((sums[gram:] - sums[:-gram]) * power(_INVERSE)[: n - gram + 1])
    span = window - gram + 1
    # Rank by the upper 36 bits, then by place; least of each span from running minima of blocks of a span.
    v = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(v) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(v)] = v
    grid = grid.reshape(blocks, span)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - window + 1
    least = np.minimum(down[:m], up[span - 1 : span - 1 + m])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(start, m))
    return h[(least[start] & np.uint64((1 << 28) - 1)).astype(np.int64)].view(np.int64), start, count


#: Longer texts are cut for hashing into stretches of this many bytes that overlap by a window less one byte.
PART = 1 << 24


def _anchor_rows(batches):
    for b in batches:
        u, v, texts = b["u"].to_pylist(), b["v"].to_pylist(), b["text"].to_pylist()
        out = [[], [], [], []]
        for k, text in enumerate(texts):
            data = np.frombuffer(text.encode(), np.uint8)
            for base in range(0, max(1, len(data) - WINDOW + 1), PART):
                f, start, count = anchors(data[base : base + PART + WINDOW - 1])
                out[0].append(f)
                out[1].append(np.full(len(f), u[k], np.int64))
                out[2].append(np.full(len(f), v[k], np.int32))
                out[3].append((base + start) << 8 | count)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2].astype(np.int32)), pa.array(cols[3], pa.int64())], ["f", "u", "v", "at"])


STRETCH = "route long, bytes binary, copies int, u long, v int, start long, count int"
_NAMES = [x.split()[0] for x in STRETCH.split(", ")]


def _route(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def _stretches(batches):
    """Stretches for the shards: of equal ones in a batch only one, without a place, for they are known to be repeated;
    their places are told at once, as rows without bytes. Those of a hot anchor are cut in windows after that."""
    for b in batches:
        seen: dict[tuple[int, bool, bytes], list] = {}
        for u, v, text, wanted in zip(b["u"].to_pylist(), b["v"].to_pylist(), b["text"].to_pylist(), b["wanted"].to_pylist(), strict=True):
            data = text.encode()
            for x in wanted:
                start, count = x["at"] >> 8, x["at"] & 255
                seen.setdefault((x["f"], x["hot"], data[start : start + count + WINDOW - 1]), []).append((u, v, start, count))
        rows = []
        for (route, hot, piece), places in seen.items():
            alone = len(places) == 1
            if not alone:
                rows += [(p[0], None, 0, *p) for p in places]
            u, v, start, count = places[0]
            if not hot:
                rows.append((route, piece, 1, u, v, start, count) if alone else (route, piece, 2, None, None, None, None))
                continue
            for i in range(count):
                window = piece[i : i + WINDOW]
                rows.append((_route(window), window, 1, u, v, start + i, 1) if alone else (_route(window), window, 2, None, None, None, None))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _shards(batches):
    """The one shard of a partition, whatever batches it comes in."""
    got = [b for b in batches if b.num_rows]
    if got:
        yield from _shard(pa.Table.from_batches(got)).to_batches()


def _shard(table: pa.Table) -> pa.Table:
    """Repeated windows (u, v, start, count) of one shard's stretches."""
    table = table.combine_chunks()
    known = table.filter(pa.compute.is_null(table["bytes"]))
    table = table.filter(pa.compute.is_valid(table["bytes"]))
    pieces, weight, of = {}, [], []
    for piece, copies in zip(table["bytes"].to_pylist(), table["copies"].to_pylist(), strict=True):
        i = pieces.setdefault(piece, len(pieces))
        if i == len(weight):
            weight.append(0)
        weight[i] += copies
        of.append(i)
    out = [[known[c].to_numpy() for c in ("u", "v", "start", "count")]]
    if pieces:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sa = suffix_array(np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0)))[1:]
        together = repeated_in(sa, data)
        group = np.cumsum(np.concatenate(([0], ~together)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.arange(len(data)) + WINDOW <= np.repeat(ends, sizes)
        times = np.where(whole, np.array(weight)[owner], 0)
        many = np.empty(len(data), bool)
        many[sa] = np.bincount(group, weights=times[sa])[group] >= 2
        many &= whole
        edge = np.diff(np.concatenate(([0], many.astype(np.int8), [0])))
        # Runs of repeated windows; a run never goes on into the next stretch, whose last 199 places are no window starts.
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(owner[a], np.arange(len(sizes) + 1))
        # Every run of a piece, for each row of the table that has a place.
        row = np.flatnonzero(table["u"].is_valid().to_numpy(zero_copy_only=False))
        piece = np.array(of)[row]
        times = first[piece + 1] - first[piece]
        row, piece = np.repeat(row, times), np.repeat(piece, times)
        run = first[piece] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        u, v, start = (table[c].fill_null(0).to_numpy()[row] for c in ("u", "v", "start"))
        out.append([u, v, start + a[run] - starts[piece], b[run] - a[run]])
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table({"u": pa.array(cols[0].astype(np.int64)), "v": pa.array(cols[1].astype(np.int32)), "start": pa.array(cols[2].astype(np.int64)), "count": pa.array(cols[3].astype(np.int32))})


def _removed(batches):
    for b in batches:
        rows = []
        for text, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True):
            data = text.encode()
            spans: list[list[int]] = []
            for start, end in sorted((r["start"], r["start"] + r["count"] + WINDOW - 1) for r in runs or ()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([start, end])
            at, kept = 0, hashlib.sha256()
            for start, end in spans:
                kept.update(data[at:start])
                at = end
            kept.update(data[at:])
            rows.append((len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b["__id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Every text without the bytes that a repeated 200-byte string covers: id, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256``.

    Repeats are judged on the input, in UTF-8 bytes, over all rows: a repeated row repeats all of a text of 200 bytes or
    more. A null text is empty; shorter texts are kept whole; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"),
        F.xxhash64(text_of_id(id_col), text_or_empty(text_col)).alias("u"), F.hash(text_or_empty(text_col)).alias("v"),
    )
    rows = written(texts.select("u", "v", "text").filter(F.octet_length("text") >= WINDOW).mapInArrow(_anchor_rows, "f long, u long, v int, at long"))
    # Written apart, so that AQE can split the join at an anchor that many texts share.
    twice = written(rows.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1"))
    wanted = rows.join(twice, "f").select("u", "v", F.struct("f", "at", (F.col("n") > hot).alias("hot")).alias("x"))
    wanted = written(wanted.groupBy("u", "v").agg(F.collect_set("x").alias("wanted")))
    size = wanted.agg(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda a, x: a + x["at"].bitwiseAND(255) + WINDOW - 1))).first()[0] or 0
    shards = max(1, math.ceil(size / shard))
    # Both joins take the same columns of the texts, so that these are shuffled once for both.
    cut = texts.join(wanted, ["u", "v"]).select("__id", "u", "v", "text", "wanted").mapInArrow(_stretches, STRETCH)
    # A partition is a shard, by its number: hashing the numbers again would put several in one task and none in others.
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int")
    found = cut.repartitionById(shards, shard).mapInArrow(_shards, "u long, v int, start long, count int")
    runs = found.groupBy("u", "v").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    return texts.join(runs, ["u", "v"], "left").select("__id", "u", "v", "text", "runs").mapInArrow(_removed, f"__id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("__id", id_col)
