"""The trie of conversation prefixes, from sorted sequences and their common prefixes.

A turn is 16 bytes of a SHA-256 over role and text, a conversation the concatenation of its turns, and equal conversations are
one row. The rows are sorted into shards by range. In a shard the lengths of the common prefixes of neighbours (LCPs) are an
array with a sparse table of range minima above it, and every prefix (row, depth) finds the rows that share it by two binary
searches in that table, to the left and to the right, each on its own and without a stack. What a prefix has over these rows
comes from prefix sums and from a sparse table of smallest ids.

A prefix that goes on beyond a shard has a part in each shard it reaches: those of a shard's first and of its last row, so one
row a depth and shard. These parts are added up first and go back to the shards, which then make the nodes; so a prefix that a
third of all conversations share costs a row a shard, like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, written

#: Bytes of a turn in a sequence, of the rows of a shard (about), and ids that are listed together for a digest.
TURN, SHARD, LISTED = 16, 1_000_000, 1000
#: Shards; beyond so many they grow.
SHARDS = 250_000
#: Turns that a conversation may take over from the first of its five.
TAKEN = 8
NOTHING = hashlib.sha256(b"").hexdigest()


# ---- conversations ---------------------------------------------------------------------------------------------------


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell (role, text) apart; the length in front keeps the two apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (key, bytes)) of each conversation, by turn, a null turn first and equal turns by role and key.
    Null roles and texts are empty; rows of a null conversation are of none; repeated rows are turns of their own. An empty table
    gives no rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    row = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    one = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), row.alias("t"))
    sorted_ = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return sorted_.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation c of (conv_id, turns) with its first h turns those of c - c % 5, h = crc32(c) % 9 (all if fewer, none
    if absent), before its own after the first h. Turnless ones stay."""
    own = conversations.withColumn("h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (TAKEN + 1)).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    first = conversations.filter(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, TAKEN).alias("taken"))
    turns = F.concat(F.slice(F.coalesce("taken", F.array().cast(conversations.schema["turns"].dataType)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return own.join(first, "base", "left").select("conv_id", turns.alias("turns"))


def _in_order(batches):
    """Lists of ids (seq, ids), sorted by sequence and place: a digest a sequence, fed a list at a time."""
    state = seq = None
    out: list = []

    def flush():
        table = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["seq", "ends"])
        out.clear()
        return table

    for b in batches:
        for s, text in zip(b["seq"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if s != seq:
                if state:
                    out.append((seq, state.hexdigest()))
                state, seq = hashlib.sha256(text.encode()), s
            else:
                state.update(b"," + text.encode())
            if len(out) >= 5000:
                yield flush()
    if state:
        out.append((seq, state.hexdigest()))
    if out:
        yield flush()


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(seq, bytes, n, least, ends): each sequence of (conv_id, turns) once, with the bytes of its turns' texts, how many have it,
    the smallest id and the SHA-256 of all ids, ascending, comma-joined.

    Ids are listed ``LISTED`` numbers at a time, so that the copies of a sequence are never one group; the digest of one
    sequence reads its lists one after another, as SHA-256 must."""
    seqs = conversations.select("conv_id", F.array_join(F.transform("turns", lambda x: F.hex(x["key"])), "").alias("__hex"), F.transform("turns", lambda x: x["bytes"]).alias("bytes"))
    seqs = seqs.select("conv_id", F.unhex("__hex").alias("seq"), "bytes", F.expr(f"conv_id div {LISTED}").alias("listed"))
    ids = F.array_sort(F.collect_list("conv_id"))
    lists = written(seqs.groupBy("seq", "listed").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(ids.cast("array<string>"), ",").alias("ids")))
    ends = lists.select("seq", "listed", "ids").repartition("seq").sortWithinPartitions("seq", "listed").select("seq", "ids").mapInArrow(_in_order, "seq binary, ends string")
    return lists.groupBy("seq").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least")).join(ends, "seq")


# ---- shards ----------------------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common."""
    n = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(s, "V16", n) for s in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


class Minima:
    """Sparse table: minima over ranges of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of x[lo : hi + 1]."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all of x[at + 1 :] is ``least`` or more."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, start = self.rows[k], at + 1
            ok = start < len(row)
            ok[ok] = row[start[ok]] >= least[ok]
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all of x[: at + 1], without it, is ``least`` or more."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, start = self.rows[k], at - (1 << k) + 1
            ok = start >= 0
            ok[ok] = row[start[ok]] >= least[ok]
            at[ok] -= 1 << k
        return at


class Shard:
    """Rows of a shard in order, with its neighbours' nearest ones (null where there are none)."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("at")
        self.seq = rows["seq"].to_pylist()
        self.n = rows["n"].to_numpy()
        self.least = rows["least"].to_numpy()
        self.ends = rows["ends"].to_pylist()
        self.length = np.array([len(s) // TURN for s in self.seq], np.int64)
        sizes = rows["bytes"].combine_chunks()
        self.sizes, self.offset = sizes.flatten().to_numpy(zero_copy_only=False), np.cumsum(self.length) - self.length
        before, after = rows["before"][0].as_py(), rows["after"][0].as_py()
        # lcp[0] is that with the row before the shard, or -1 at the very start: even the root begins there.
        self.lcp = np.array([-1 if before is None else _common(before, self.seq[0]), *map(_common, self.seq[:-1], self.seq[1:])], np.int64)
        self.after = -1 if after is None else _common(self.seq[-1], after)
        next_ = np.append(self.lcp[1:], self.after)
        self.leaf = (next_ < self.length).astype(np.int64)
        # Every prefix once in the shard: all of the first row's, and of another row those that the row before lacks.
        new = np.append(0, self.lcp[1:] + 1)
        count = self.length - new + 1
        self.row = np.repeat(np.arange(len(self.seq)), count)
        self.depth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(new, count)
        inside = self.lcp.copy()
        inside[0] = -1
        table = Minima(inside)
        self.lo, self.hi = table.left(self.row, self.depth), table.right(self.row, self.depth)
        self.begins = self.depth > self.lcp[self.row]
        upto = lambda x: np.append(0, np.cumsum(x))
        n, leaves = upto(self.n), upto(self.leaf)
        self.n_convs = n[self.hi + 1] - n[self.lo]
        self.n_leaves = leaves[self.hi + 1] - leaves[self.lo]
        self.smallest = Minima(self.least).over(self.lo, self.hi)
        size = np.zeros(len(self.row), np.int64)
        texts = self.depth > 0
        size[texts] = self.sizes[self.offset[self.row[texts]] + self.depth[texts] - 1]
        # Nodes are in the order of a walk from the root, so a subtree is a stretch of them: from a node to the last of row hi.
        saved = upto((self.n_convs - self.begins) * size)
        last = np.cumsum(count)[self.hi]
        self.saved = saved[last] - saved[np.arange(len(self.row))]
        # Children begin one deeper in the same rows.
        key = (self.depth * len(self.seq) + self.row)[self.begins]
        key.sort()
        self.n_children = np.searchsorted(key, (self.depth + 1) * len(self.seq) + self.hi, "right") - np.searchsorted(key, (self.depth + 1) * len(self.seq) + self.lo, "left")
        self.new = new
        self.open = ((self.hi == len(self.seq) - 1) & (self.depth <= self.after)) | ((self.lo == 0) & (self.depth <= self.lcp[0]))

    def names(self, nodes: np.ndarray) -> list[bytes]:
        """Digests of open prefixes, which are those of the first row or of the last."""
        out = []
        for row in (0, len(self.seq) - 1):
            state, at = hashlib.sha256(), [hashlib.sha256().digest()]
            for d in range(int(self.length[row])):
                state.update(self.seq[row][d * TURN : (d + 1) * TURN])
                at.append(state.copy().digest())
            out.append(at)
        first = self.lo[nodes] == 0
        return [out[0][d] if f and d <= self.length[0] else out[1][d] for d, f in zip(self.depth[nodes].tolist(), first.tolist(), strict=True)]


EDGES = "shard long, name binary, depth long, n_convs long, smallest long, n_children long, n_leaves long, saved long"


def _edges(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The parts of a shard's prefixes that go on beyond it."""
    s = Shard(rows)
    at = np.flatnonzero(s.open)
    columns = [pa.array(np.full(len(at), key[0].as_py())), pa.array(s.names(at), pa.binary()), *(pa.array(x[at].astype(np.int64)) for x in (s.depth, s.n_convs, s.smallest, s.n_children, s.n_leaves, s.saved))]
    return pa.Table.from_arrays(columns, ["shard", "name", "depth", "n_convs", "smallest", "n_children", "n_leaves", "saved"])


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _nodes(key: tuple[pa.Scalar, ...], rows: pa.Table, edges: pa.Table) -> pa.Table:
    """The nodes that begin in a shard; ``edges`` has what its open prefixes are over all shards."""
    s = Shard(rows)
    values = {c: getattr(s, c).astype(np.int64) for c in ("n_convs", "smallest", "n_children", "n_leaves", "saved")}
    at = np.flatnonzero(s.open)
    if len(at):
        place = {n: i for i, n in enumerate(edges["name"].to_pylist())}
        of = np.array([place[n] for n in s.names(at)])
        for c, x in values.items():
            x[at] = edges[c].to_numpy()[of]
    nodes = np.arange(len(s.row))
    # A row's shallowest new prefix hangs under one that an earlier row has: the prefix of that depth whose rows reach this one.
    parent = nodes - 1
    shallow = np.flatnonzero((s.depth == s.new[s.row]) & (s.depth > 0))
    if len(shallow):
        order = np.lexsort((s.row, s.depth))
        packed = s.depth[order] * len(s.seq) + s.row[order]
        want = (s.depth[shallow] - 1) * len(s.seq) + s.row[shallow]
        parent[shallow] = order[np.searchsorted(packed, want, "right") - 1]
    top = s.depth == 0
    parents = np.where(top, 0, values["smallest"][np.maximum(parent, 0)])
    exact = s.depth == s.length[s.row]
    ends = np.where(exact, np.array(s.ends, object)[s.row], NOTHING)
    keep = np.flatnonzero(s.begins)
    column = lambda x: pa.array(x[keep])
    return pa.Table.from_arrays(
        [column(values["smallest"]), column(s.depth), pa.array(parents[keep], mask=top[keep]), *(column(values[c]) for c in ("n_convs", "n_children", "n_leaves", "saved")), pa.array(ends[keep].tolist(), pa.string())],
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    )


ROWS = "seq binary, bytes array<long>, n long, least long, ends string, shard long, at long"


def _numbered(batches):
    """Rows with their shard and their place in it."""
    shard, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, shard, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))], [*b.schema.names, "shard", "at"])
        at += n


def prefix_trie(conversations: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """A row for every distinct prefix of the sequences in (conv_id, turns: array of (key, bytes)), the root included.

    ``conv_id`` is the smallest member, ``depth`` the turns, ``parent_conv_id`` the parent's ``conv_id`` (null for the root),
    ``n_convs`` the members, ``n_children`` the children, ``n_leaves`` the childless nodes of the subtree, itself included,
    ``saved_tokens`` the bytes that its subtree's nodes save where members share them, ``ends_sha256`` the SHA-256 of the ids of
    those that end there. Turnless conversations are members of the root; equal ones are all members; an empty table has no
    root. A conversation's turns are one row (24 bytes a turn), and so are the prefixes of one row in a shard's arrays.
    """
    ship(conversations.sparkSession)
    seqs = written(distinct_sequences(conversations))
    total = seqs.agg(F.sum(F.octet_length("seq") + 8 * F.size("bytes") + 64)).first()[0] or 0
    shards = min(SHARDS, int(total // shard_bytes) + 1)
    rows = written(seqs.repartitionByRange(shards, "seq").sortWithinPartitions("seq").select("seq", "bytes", "n", "least", "ends").mapInArrow(_numbered, ROWS))
    # One row a shard.
    bounds = rows.groupBy("shard").agg(F.min("seq").alias("__first"), F.max("seq").alias("__last"))
    beside = Window.orderBy("shard")
    bounds = written(bounds.select("shard", F.lag("__last").over(beside).alias("before"), F.lead("__first").over(beside).alias("after")))
    inside = rows.join(bounds, "shard")
    parts = written(inside.groupBy("shard").applyInArrow(_edges, EDGES))
    sums = parts.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.min("smallest").alias("smallest"))
    edges = parts.select("shard", "name").join(sums, "name")
    return inside.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_nodes, NODES)


def conversation_trie(turns: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``prefix_trie`` of the conversations rebuilt by ``rebuilt`` from rows (conv_id, turn, role, text). Nulls, ties, repeated
    rows and empty tables as in ``sequences``; other columns are not read."""
    return prefix_trie(rebuilt(written(sequences(turns))), shard_bytes)
