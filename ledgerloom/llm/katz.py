"""Language-model scores by a Katz bigram model.

P(w | h) is the Good-Turing discounted count of (h, w) over the count of h plus 1 where the pair was seen, and
alpha(h) * P(w) else; P(w) is the discounted count of w over the count of all tokens plus 1, and what that leaves is the
probability of the one event that stands for all words never seen. alpha(h) is what h leaves to unseen words over what P leaves
to them, so that each context's probabilities sum to 1 exactly. The 1 more in the denominators leaves something even where all
counts are too large to be discounted.

The text is read once, into a table of blocks: of each some millions of tokens, the hashes of its words and its tokens as
numbers of words. Blocks send each of their distinct words and pairs once to a bucket of its hash, where counts of all blocks
are summed (and of each pair one block made owner). The sums are stored as a table of n-gram counts, one folder an order, from
which the discounts come, and the blocks get theirs back in order. Owners then add up what each context leaves, by context;
the alphas are stored as a table too, and a last exchange brings their logarithms to the texts that back off. No task holds
more than a block or a bucket.

An n-gram's key is Spark's ``xxhash64`` of its words' keys in order, a word's that of its text: 64 bits, not confirmed, so that
of 10^9 distinct n-grams about 0.03 pairs, and of 10^11 about 270, share a key and a count.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ship, text_of_id, text_or_empty, written

#: Tokens of a block, about, and distinct entries of a bucket, at most about.
BLOCK, BUCKET = 1_000_000, 1_000_000
#: Rows of counts that go to the JVM at once.
CHUNK = 50_000
#: Counts above this are not discounted.
LARGE = 5
END = b""
#: Seed of Spark's own ``xxhash64``.
SEED = 42


def held_out(id_col: str):
    return (F.crc32(F.encode(text_of_id(id_col), "UTF-8")) % 5) == 1


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte of the number, compressed: small or repeated ones take next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes, dtype=np.uint64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


# ---- blocks ----------------------------------------------------------------------------------------------------------


def _blocks(size: int):
    def of(batches):
        import xxhash

        ids, sizes, held, streams, made = [], [], [], [], 0
        number: dict[bytes, int] = defaultdict()

        def fresh():
            number.clear()
            number.default_factory = number.__len__
            number[END]

        def block():
            stream = np.concatenate(streams) if streams else np.zeros(0, np.uint64)
            words = list(number)
            # The end stays first; words follow by frequency, so that frequent ones have small numbers.
            order = np.concatenate(([0], 1 + np.argsort(-np.bincount(stream.astype(np.int64), minlength=len(words))[1:], kind="stable")))
            place = np.empty(len(words), np.uint64)
            place[order] = np.arange(len(words), dtype=np.uint64)
            keys = np.array([xxhash.xxh64_intdigest(words[i], SEED) for i in order], np.uint64)
            row = [[(TaskContext.get().partitionId() << 24) | made], [ids[:]], [_pack(np.array(sizes, np.uint64))], [_pack(np.array(held, np.uint64))], [_pack(keys)], [_pack(place[stream.astype(np.int64)])], [len(stream)]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.list_(kind)), *(pa.array(x, pa.binary()) for x in row[2:6]), pa.array(row[6], pa.int64())], ["block", "ids", "sizes", "held", "keys", "stream", "n"])

        fresh()
        total = 0
        for b in batches:
            kind = b.schema.field("__id").type
            for i, text, out in zip(b["__id"].to_pylist(), b["text"].to_pylist(), b["held"].to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                words.append(END)
                streams.append(np.fromiter(map(number.__getitem__, words), np.uint64, len(words)))
                ids.append(i)
                sizes.append(len(words))
                held.append(out)
                total += len(words)
                if total >= size:
                    yield block()
                    ids, sizes, held, streams, made, total = [], [], [], [], made + 1, 0
                    fresh()
        if ids:
            yield block()

    return of


def _open(sizes: bytes, stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of a block's texts, its tokens, and (context, word) of each token as one number."""
    sizes, stream = _unpack(sizes).astype(np.int64), _unpack(stream)
    before = np.concatenate((np.zeros(1, np.uint64), stream[:-1]))
    starts = np.cumsum(sizes) - sizes
    before[starts] = 0
    return sizes, stream, before << np.uint64(32) | stream


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _then(seed: np.ndarray, x: np.ndarray) -> np.ndarray:
    """XXH64 of each number's 8 bytes, seeded with the hash of what stands before it: ``xxhash64`` of several longs."""
    turned = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = turned((seed + _P5 + np.uint64(8)) ^ turned(x * _P2, 31) * _P1, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _pair_keys(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    h, w = keys[(pairs >> np.uint64(32)).astype(np.int64)], keys[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return _then(_then(np.full(1, SEED, np.uint64), h), w)


def _cuts(x: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin and end: each has an equal part of the range."""
    return np.concatenate(([0], np.searchsorted(x, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)), [len(x)]))


def _sent(buckets: int):
    """Distinct words (kind 0) and pairs (kind 1) of each block with their counts in its training texts, by bucket."""

    def of(batches):
        for b in batches:
            for block, sizes, held, keys, stream in zip(*(b[c].to_pylist() for c in ("block", "sizes", "held", "keys", "stream")), strict=True):
                keys = _unpack(keys)
                sizes, stream, pairs = _open(sizes, stream)
                learn = np.repeat(_unpack(held) == 0, sizes)
                distinct, at = np.unique(pairs, return_inverse=True)
                for kind, hashes, n in (
                    (0, keys, np.bincount(stream[learn].astype(np.int64), minlength=len(keys))),
                    (1, _pair_keys(keys, distinct), np.bincount(at[learn], minlength=len(distinct))),
                ):
                    order = np.argsort(hashes, kind="stable")
                    hashes, n = hashes[order], n[order].astype(np.uint64)
                    cut = _cuts(hashes, buckets)
                    rows = [(i, kind, block, _pack_sorted(hashes[s:e]), _pack(n[s:e])) for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "block", "a", "b"])

    return of


TOTALS = "what string, bucket int, kind int, block long, a binary, b binary, gram long, n long, name long"


def _totals(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts over all blocks: as rows of the table of counts (``count``), and sent back to each block in its order
    (``answer``): of words with a number for each, of pairs with a mark for the block that owns it."""
    bucket, kind = key[0].as_py(), key[1].as_py()
    blocks = table["block"].to_pylist()
    parts = [_unpack_sorted(x) for x in table["a"].to_pylist()]
    counts = [_unpack(x) for x in table["b"].to_pylist()]
    at = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.concatenate(counts)
    del parts, counts
    total = np.bincount(inverse, weights=n, minlength=len(distinct)).astype(np.uint64)
    owner = np.zeros(len(n), np.uint64)
    known = np.flatnonzero(n > 0)
    owner[known[np.unique(inverse[known], return_index=True)[1]]] = 1
    rows = []
    for block, s, e in zip(blocks, at, at[1:], strict=False):
        i = inverse[s:e]
        if kind:
            rows.append((block, _pack(total[i] << np.uint64(1) | owner[s:e]), b""))
        else:
            rows.append((block, _pack(total[i]), _pack_sorted((np.uint64(bucket) << np.uint64(32)) + i.astype(np.uint64))))
    seen = np.flatnonzero(total)
    fields = dict(what=pa.string(), bucket=pa.int32(), kind=pa.int32(), block=pa.int64(), a=pa.binary(), b=pa.binary(), gram=pa.int64(), n=pa.int64(), name=pa.int64())
    of = lambda size, **given: pa.table({c: pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in fields.items()})
    block, a, b = zip(*rows, strict=True)
    answers = of(len(rows), what=["answer"] * len(rows), bucket=[bucket] * len(rows), kind=[kind] * len(rows), block=block, a=a, b=b)
    names = {} if kind else {"name": (bucket << 32) + seen}
    table = of(len(seen), what=["count"] * len(seen), bucket=np.full(len(seen), bucket, np.int32), kind=np.full(len(seen), kind, np.int32), gram=distinct[seen].view(np.int64), n=total[seen].astype(np.int64), **names)
    # In chunks, each a batch of its own on the way to the JVM.
    return pa.concat_tables([*(table.slice(i, CHUNK) for i in range(0, len(table), CHUNK)), answers])


# ---- discounts -------------------------------------------------------------------------------------------------------


def discounts(of_counts, large: int = LARGE) -> np.ndarray:
    """Factor of each count 0..large (0 for 0): Katz's renormalised Good-Turing ratios, with the largest limit that gives
    factors in (0, 1) for all counts; half a count off each where none does."""
    for k in range(large, 0, -1):
        n = [0.0, *map(float, of_counts[: k + 1])]
        if n[1] <= 0 or any(n[r] <= 0 for r in range(1, k + 1)):
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = [((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d, *[1.0] * (large - k)])
    return np.array([0.0, *((r - 0.5) / r for r in range(1, large + 1))])


def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    n = n.astype(np.float64)
    return n * np.where(n < len(d), d[np.minimum(n, len(d) - 1).astype(np.int64)], 1.0)


# ---- scores ----------------------------------------------------------------------------------------------------------

SCORES = "kind int, block long, at int, id {id}, held_out boolean, n_tokens long, n_known long, base_score double, part double, bucket int, h binary, n binary, pairs binary, words binary, texts binary, which binary"


def _scored(d1: np.ndarray, d2: np.ndarray, total: int, words: int, left: float):
    """Of each block: for each text all but the logarithms of its alphas (kind 0); for each bucket of contexts, what the pairs
    that this block owns take of the context and of P, and which texts back off from it (kind 1)."""

    def of(mine: pa.Table, back: pa.Table) -> pa.Table:
        names = ["kind", "block", "at", "id", "held_out", "n_tokens", "n_known", "base_score", "part", "bucket", "h", "n", "pairs", "words", "texts", "which"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), mine.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 6]
        if not len(mine):
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds, strict=True)})
        block = mine["block"][0].as_py()
        keys = _unpack(mine["keys"][0].as_py())
        sizes, stream, pairs = _open(mine["sizes"][0].as_py(), mine["stream"][0].as_py())
        held = _unpack(mine["held"][0].as_py()) == 1
        back = sorted(zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["a"].to_pylist(), back["b"].to_pylist(), strict=True), key=lambda r: r[:2])
        count, name = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint64)
        order = np.argsort(keys, kind="stable")
        count[order] = np.concatenate([_unpack(r[2]) for r in back if r[0] == 0])
        name[order] = np.concatenate([_unpack_sorted(r[3]) for r in back if r[0] == 0])
        distinct, of_pair = np.unique(pairs, return_inverse=True)
        marked = np.empty(len(distinct), np.uint64)
        marked[np.argsort(_pair_keys(keys, distinct), kind="stable")] = np.concatenate([_unpack(r[2]) for r in back if r[0] == 1])
        own, met = (marked & np.uint64(1)).astype(bool), marked >> np.uint64(1)
        h, w = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = np.where(count > 0, discounted(count, d1) / (total + 1.0), left)
        with np.errstate(divide="ignore"):
            score = np.log10(np.where(met > 0, discounted(met, d2) / (count[h] + 1.0), p[w]))
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda x: np.bincount(text, weights=x, minlength=len(sizes))
        tokens = stream.astype(np.int64)
        known = sums((count[tokens] > 0).astype(float)).astype(np.int64)
        base = sums(np.log10((count[tokens] + 0.5) / (total + 0.5 * (words + 1))))
        part = sums(score[of_pair])
        blank = [None] * len(sizes)
        columns = [[0] * len(sizes), [block] * len(sizes), np.arange(len(sizes), dtype=np.int32), mine["ids"][0].as_py(), held, sizes, known, base, part, *[blank] * 7]
        docs = pa.table({c: pa.array(x, t) for c, x, t in zip(names, columns, kinds, strict=True)})
        # Contexts: sums over the pairs owned here, and the tokens that back off, by number of the context.
        taken = np.bincount(h[own], weights=discounted(met[own], d2), minlength=len(keys))
        covered = np.bincount(h[own], weights=p[w[own]], minlength=len(keys))
        backs = np.flatnonzero(((met == 0) & (count[h] > 0))[of_pair])
        whose = h[of_pair[backs]]
        used = np.unique(np.concatenate((h[own], whose)))
        used = used[np.argsort(name[used], kind="stable")]
        place = np.full(len(keys), -1, np.int64)
        place[used] = np.arange(len(used))
        # Each (context, text) once, with how often.
        mixed, often = np.unique(place[whose].astype(np.uint64) << np.uint64(32) | text[backs].astype(np.uint64), return_counts=True)
        at_context = (mixed >> np.uint64(32)).astype(np.int64)
        bucket = (name[used] >> np.uint64(32)).astype(np.int64)
        rows = []
        for b in np.unique(bucket):
            s, e = np.searchsorted(bucket, [b, b + 1])
            i, j = np.searchsorted(at_context, [s, e])
            u = used[s:e]
            rows.append((1, block, None, None, None, None, None, None, None, int(b), _pack_sorted(name[u]), _pack(count[u]), _pack(taken[u]), _pack(covered[u]), _pack_sorted(mixed[i:j] - (np.uint64(s) << np.uint64(32))), _pack(often[i:j].astype(np.uint64))))
        if not rows:
            return docs
        return pa.concat_tables([docs, pa.table({c: pa.array(x, t) for c, x, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})])

    return of


def _alphas(table: pa.Table) -> pa.Table:
    """One bucket of contexts: alpha of each (by its number), and of each block the sums of log10 alpha over the tokens that
    back off, by text."""
    h = [_unpack_sorted(x) for x in table["h"].to_pylist()]
    distinct, inverse = np.unique(np.concatenate(h), return_inverse=True)
    n, taken, covered = (np.concatenate([_unpack(x, t) for x in table[c].to_pylist()]) for c, t in (("n", np.uint64), ("pairs", np.float64), ("words", np.float64)))
    count = np.zeros(len(distinct))
    count[inverse] = n
    alpha = (1 - np.bincount(inverse, weights=taken) / (count + 1)) / (1 - np.bincount(inverse, weights=covered))
    logs = np.log10(alpha)[inverse]
    blocks, texts, sums, start = [], [], [], 0
    for block, part, mixed, often in zip(table["block"].to_pylist(), h, table["texts"].to_pylist(), table["which"].to_pylist(), strict=True):
        mixed, often = _unpack_sorted(mixed), _unpack(often)
        at, i = np.unique((mixed & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
        blocks.append(block)
        texts.append(_pack_sorted(at))
        sums.append(_pack(np.bincount(i, weights=logs[start + (mixed >> np.uint64(32)).astype(np.int64)] * often, minlength=len(at)).astype(np.float64)))
        start += len(part)
    sent = pa.table({"block": pa.array(blocks, pa.int64()), "texts": pa.array(texts, pa.binary()), "sums": pa.array(sums, pa.binary()), "name": pa.nulls(len(blocks), pa.int64()), "alpha": pa.nulls(len(blocks), pa.float64())})
    none = lambda t: pa.nulls(len(distinct), t)
    return pa.concat_tables([sent, pa.table({"block": none(pa.int64()), "texts": none(pa.binary()), "sums": none(pa.binary()), "name": pa.array(distinct.view(np.int64)), "alpha": pa.array(alpha)})])


def _summed(texts: pa.Table, alphas: pa.Table) -> pa.Table:
    """A block's texts with what its buckets say of their alphas added."""
    texts = texts.combine_chunks()
    more = np.zeros(int(texts["at"].to_numpy().max()) + 1 if len(texts) else 0)
    for at, part in zip(alphas["texts"].to_pylist(), alphas["sums"].to_pylist(), strict=True):
        more[_unpack_sorted(at).astype(np.int64)] += _unpack(part, np.float64)
    return texts.drop_columns(["block", "at", "part"]).append_column("score", pa.array(texts["part"].to_numpy() + more[texts["at"].to_numpy()]))


@dataclass(frozen=True)
class Model:
    """The stored model. ``ngrams``: order, gram, n, name (of order 1) of every n-gram seen; ``alphas``: name, alpha of every
    context that was followed by something or is backed off from. ``discounts`` by order; ``left``: probability of the one
    event that stands for all words never seen."""

    ngrams: DataFrame
    alphas: DataFrame
    discounts: tuple[np.ndarray, np.ndarray]
    words: int
    total: int
    left: float


def _learned(counts: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int, int, float]:
    """Discounts by order, distinct words, tokens and what is left to unseen words, from the table of counts."""
    few = counts.groupBy("kind", F.least("n", F.lit(LARGE + 2)).alias("r")).agg(F.count("*").alias("grams"), F.sum("n").alias("tokens")).collect()
    of_counts = [np.array([sum(x.grams for x in few if x.kind == k and x.r == r) for r in range(1, LARGE + 2)], float) for k in (0, 1)]
    words, total = (sum(x[c] for x in few if x.kind == 0) for c in ("grams", "tokens"))
    d1, d2 = map(discounts, of_counts)
    r = np.arange(1, LARGE + 1)
    return (d1, d2), words, total, (1 + float(((1 - d1[1:]) * r * of_counts[0][:LARGE]).sum())) / (total + 1)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> tuple[DataFrame, Model]:
    """The scores of ``score_documents`` and the model behind them."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held"))
    blocks = written(rows.mapInArrow(_blocks(block), f"block long, ids array<{kind}>, sizes binary, held binary, keys binary, stream binary, n long"))
    buckets = max(1, math.ceil((blocks.agg(F.sum("n")).first()[0] or 0) / bucket))
    sent = blocks.mapInArrow(_sent(buckets), "bucket int, kind int, block long, a binary, b binary")
    totals = written(sent.groupBy("bucket", "kind").applyInArrow(_totals, TOTALS), "what", "kind")
    counts, back = totals.filter("what = 'count'"), totals.filter("what = 'answer'").select("bucket", "kind", "block", "a", "b")
    (d1, d2), words, total, left = _learned(counts)
    schema = SCORES.format(id=kind)
    scored = written(blocks.select("block", "ids", "sizes", "held", "keys", "stream").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored(d1, d2, total, words, left), schema))
    alphas = written(scored.filter("kind = 1").groupBy("bucket").applyInArrow(_alphas, "block long, texts binary, sums binary, name long, alpha double"))
    texts = scored.filter("kind = 0").select("block", "at", "id", "held_out", "n_tokens", "n_known", "base_score", "part")
    sums = alphas.filter("block is not null").select("block", "texts", "sums")
    out = texts.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_summed, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    model = Model(counts.select((F.col("kind") + 1).alias("order"), "gram", "n", "name"), alphas.filter("name is not null").select("name", "alpha"), (d1, d2), words, total, left)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"), model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Score every whole text under the model of those that are not held out: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` (log10 probability).

    A text is its words, A to Z lower-cased, and one end; the first word's context is the end. A null text is empty: its end
    alone. Repeated rows are learned and scored each; without training texts every token has probability 1 as the one unseen
    event; an empty table gives no rows.
    """
    return fit_and_score(docs, id_col, text_col, block, bucket)[0]


def score_by_tables(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` whole and the log10 probability of its text by the stored tables, token by token: the
    pair's discounted count if it was seen, else alpha of its context times what one order less says.

    Texts may be new ones. Null and empty texts are their end alone; repeated rows stay; an empty table gives no rows.
    """
    d1, d2 = (F.array(*(F.lit(float(x)) for x in d)) for d in model.discounts)
    discounted_ = lambda n, d: n * F.coalesce(F.get(d, F.least(n, F.lit(len(model.discounts[0]))).cast("int")), F.lit(1.0))
    words = F.array_remove(F.split(ascii_lower(text_or_empty(text_col)), r"[\x20\x09-\x0D]+"), "")
    # Numbered before anything is shuffled, and written, so that a number stays with its row.
    rows = written(docs.select(F.monotonically_increasing_id().alias("i"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.concat(words, F.array(F.lit(""))).alias("w")))
    pairs = rows.select("i", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1)).alias("h"), F.col("w").alias("w"))).alias("x"))
    tokens = pairs.groupBy("i", F.xxhash64("x.h").alias("h"), F.xxhash64("x.w").alias("w")).agg(F.count("*").alias("times")).withColumn("hw", F.xxhash64("h", "w"))
    one, two = (model.ngrams.filter(F.col("order") == k) for k in (1, 2))
    contexts = one.join(model.alphas, "name", "left").select(F.col("gram").alias("h"), F.col("n").alias("n_h"), "alpha")
    met = tokens.join(one.select(F.col("gram").alias("w"), F.col("n").alias("n_w")), "w", "left").join(contexts, "h", "left").join(two.select(F.col("gram").alias("hw"), F.col("n").alias("n_hw")), "hw", "left")
    lower = F.coalesce(discounted_(F.col("n_w"), d1) / (model.total + 1.0), F.lit(model.left))
    p = F.coalesce(discounted_(F.col("n_hw"), d2) / (F.col("n_h") + 1.0), F.coalesce("alpha", F.lit(1.0)) * lower)
    scores = met.groupBy("i").agg(F.sum(F.log10(p) * F.col("times")).alias("score"))
    return rows.select("i", "row").join(scores, "i").select("row", "score")
