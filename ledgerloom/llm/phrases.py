"""Phrase collocations by SON partitioning.

The corpus is cut into shards, each of one language: what one task reads, at most ``SHARD`` words of it. For every phrase length
a shard is mined completely at its share of the support, ``ceil(support * words here / words of the language)``: a phrase that
stays below that in every shard stays below the support in all. The phrases that some shard reports are united and counted in
every shard, which is exact. A phrase of k + 1 words is looked for only where both its parts of k words are frequent in the whole
language; that keeps it cheap where shards hold under one part in ``support`` of a language, so that their share is 1.

A shard is a row: its words as numbers of its own dictionary. At each length it sends every distinct phrase once, as the global
numbers of its two parts, and gets back those that are frequent. A global number is the least (shard, place) that holds the
phrase, so equal numbers are equal phrases without hashing. Language, document or phrase may hold any share of the words: a
phrase is counted once a shard. Phrases travel by the group of their head, many to a row: a shard sends ``GROUPS`` rows at most
and one more every ``CHUNK`` phrases, however many heads are frequent.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, ship, written

#: Words of a shard, at most about; bytes of a text that are split at once; distinct phrases of a shard in one row.
SHARD, SLICE, CHUNK = 6_000_000, 4_000_000, 50_000
#: Rows of a shard's phrases that go to the JVM at once.
BATCH = 32
#: Occurrences of a phrase whose longer ones are counted in one task, at most about.
SPLIT = 2_000_000
#: Groups that the longer phrases are dealt into, under 65,536: as many tasks at most count them.
GROUPS = 1024
#: Ranks are first taken within so many parts of a language.
PARTS = 64
SUPPORT, LONGEST, KEEP = 30, 4, 2000
#: Score and the part of a phrase's occurrences inside a longer one, in hundredths, that drops it.
SCALE, COVERED = 2_000_000, 80
UNKNOWN = "und"

#: A to Z lower-cased; what ends a piece becomes a byte that UTF-8 does not have; a tab becomes a space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
_NEXT = re.compile(rb"[^ \xff]+|\xff")


def _slices(text: bytes, size: int):
    """Cut a folded text into (words, how many of them are its own): behind a piece if one ends near, else between words, with
    the next ``LONGEST - 1`` words of the piece added as what follows. ``b"\\xff"`` ends pieces."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b"\xff", at, at + size) + 1
        if end <= at:
            end = text.find(b" ", at + size)
            end = len(text) if end < 0 else end
        words = text[at:end].replace(b"\xff", b" \xff ").split()
        after, seen = [], end
        if words and words[-1] != b"\xff":
            while len(after) < LONGEST - 1 and (m := _NEXT.search(text, seen)) and m.group() != b"\xff":
                after.append(m.group())
                seen = m.end()
        yield words + after, len(words)
        at = end
    words = text[at:].replace(b"\xff", b" \xff ").split()
    yield words, len(words)


def _pack(stream: np.ndarray) -> bytes:
    """Numbers of 4 bytes, byte by byte of the number: the upper ones are nearly always alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(stream.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


SHARDS = "shard long, lang string, n long, part int, words array<string>, counts array<long>, stream binary"


def _shards(size: int, slice_bytes: int):
    """Rows of ``SHARDS``: the dictionary in chunks, the words with the first of them. In ``stream`` 0 ends a piece, a word of
    the shard is its place + 1, and one that only follows a cut text is that with a minus. Once the open shards of a task hold
    ``size`` words, the largest is closed."""

    def of(batches):
        open_: dict[str, list] = {}
        made = total = 0

        def close(lang):
            nonlocal made, total
            number, streams, n = open_.pop(lang)
            shard = (TaskContext.get().partitionId() << 16) | made
            made, total = made + 1, total - n
            stream = np.concatenate(streams)
            counts = np.bincount(stream[stream > 0], minlength=len(number))[1:]
            words = [w.decode() for w in list(number)[1:]]
            raw = _pack(stream)
            for part, lo in enumerate(range(0, len(words), CHUNK)):
                piece = words[lo : lo + CHUNK], counts[lo : lo + CHUNK].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([part], pa.int32()), pa.array([piece[0]], pa.list_(pa.string())), pa.array([piece[1]], pa.list_(pa.int64())), pa.array([raw if part == 0 else None], pa.binary())],
                    ["shard", "lang", "n", "part", "words", "counts", "stream"],
                )

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"], strict=True):
                folded = text.as_buffer().to_pybytes().translate(_FOLD) if text.is_valid else b""
                for words, own in _slices(folded, slice_bytes):
                    if not words:
                        continue
                    if lang not in open_:
                        number = defaultdict()
                        number.default_factory = number.__len__
                        number[b"\xff"]
                        open_[lang] = [number, [], 0]
                    number, streams, _ = open_[lang]
                    x = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                    x[own:] *= -1
                    streams += [x, np.zeros(1, np.int32)]
                    n = int((x > 0).sum())
                    open_[lang][2] += n
                    total += n
                    while total >= size:
                        yield from close(max(open_, key=lambda k: open_[k][2]))
        for lang in list(open_):
            yield from close(lang)

    return of


#: The longer phrases of a group, by head and tail, and how often each occurs here. Places follow them from ``start``.
PHRASES = "shard long, part int, least long, group int, start long, heads array<long>, tails array<long>, counts array<int>, stream binary"


def _longer(split: int, groups: int = GROUPS):
    """One shard, one word more: ``left`` has its stream, ``right`` (place, id, f) which of the phrases in it are frequent. The new
    stream holds, at each word, the place + 1 of the longer phrase that starts there, 0 if none can be frequent.

    A head's longer phrases are in one group, the same in all shards. The tails of one with more than ``split`` occurrences are
    dealt into buckets, each with a group of its own."""
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("least", pa.int64()), ("group", pa.int32()), ("start", pa.int64()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("stream", pa.binary())])

    def mixed(x: np.ndarray) -> np.ndarray:
        return ((x * 0x9E3779B1) >> 16) & 0xFFFF

    def of(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        raw = [x for x in left["stream"].to_pylist() if x is not None]
        if not raw or not right.num_rows:
            return schema.empty_table()
        stream = _unpack(raw[0])
        place, ids, f = (right[c].to_numpy() for c in ("place", "id", "f"))
        sorted_ = np.argsort(place)
        place, ids, f = place[sorted_], ids[sorted_], f[sorted_]
        rank = np.zeros(max(int(np.abs(stream).max()), int(place[-1]) + 1) + 1, np.int32)
        rank[place + 1] = np.arange(1, len(place) + 1)
        known = rank[np.abs(stream)]
        at = np.flatnonzero((known[:-1] > 0) & (known[1:] > 0))
        if not len(at):
            return schema.empty_table()
        packed = known[at].astype(np.int64) * (len(place) + 1) + known[at + 1]
        keys, number = np.unique(packed, return_inverse=True)
        own = stream[at] > 0
        counts = np.bincount(number[own], minlength=len(keys)).astype(np.int32)
        head, tail = keys // (len(place) + 1) - 1, keys % (len(place) + 1) - 1
        bucket = mixed(ids[tail]) % (1 + f[head] // split)
        group = (mixed(ids[head] + bucket) % groups).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        moved = np.empty(len(keys), np.int64)
        moved[order] = np.arange(len(keys))
        head, tail, group, counts, number = head[order], tail[order], group[order], counts[order], moved[number]
        new = np.zeros(len(stream), np.int32)
        new[at] = np.where(own, number + 1, -(number + 1))
        begins = np.append(True, group[1:] != group[:-1])
        # So many keys end a row; a group that goes on there has two.
        begins[::CHUNK] = True
        rows = np.flatnonzero(begins)
        ends = pa.array(np.append(rows, len(keys)), pa.int32())
        one = [np.full(len(rows), left["shard"][0].as_py()), np.arange(len(rows), dtype=np.int32), np.full(len(rows), left["least"][0].as_py()), group[rows].astype(np.int32), rows.astype(np.int64)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[head], ids[tail], counts)]
        out = pa.Table.from_arrays([*map(pa.array, one), *lists, pa.array([_pack(new)] + [None] * (len(rows) - 1), pa.binary())], schema=schema)
        return pa.Table.from_batches(out.to_batches(max_chunksize=BATCH), schema)

    return of


def _number(shard: Column, place: Column) -> Column:
    """24 bits of place: a shard's distinct phrases are fewer than its words. 16 bits number the shards of a task."""
    return shard * (1 << 24) + place


def _frequent(keys: DataFrame, on: list[str], support: int) -> DataFrame:
    """(number, id, f, *on) of the rows (number, count, least, *on) whose key some shard reports and whose count over all shards
    is ``support`` or more. Reports and counts travel together: one exchange, and no shard is asked again."""
    all_of = Window.partitionBy(*on)
    rows = keys.select("number", "count", (F.col("count") >= F.col("least")).alias("reported"), *on)
    united = rows.select("number", *on, F.max("reported").over(all_of).alias("candidate"), F.sum("count").over(all_of).alias("f"), F.min("number").over(all_of).alias("id"))
    return written(united.filter(F.col("candidate") & (F.col("f") >= support)).select("number", "id", "f", *on))


def _firsts(found: DataFrame) -> DataFrame:
    """Each frequent phrase once: as its first shard has it."""
    return found.filter("id = number")


def phrase_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD, slice_bytes: int = SLICE, split: int = SPLIT, groups: int = GROUPS) -> tuple[list[DataFrame], DataFrame]:
    """Every phrase of 1 to ``longest`` (at most 4) words that occurs ``support`` times or more in its language, and the words
    of each language.

    The first is a table for each length: ``lang``, ``id``, ``phrase``, ``last`` (its last word), ``f``, ``heads`` and
    ``tails`` (the counts of its first 1, 2, ... and of its last 1, 2, ... words), ``head`` and ``tail`` (ids of what is left
    without the last and without the first word; null for words). The second has ``lang`` and ``n``.

    A null text has no words, a null language is ``und``; repeated rows count each time; texts of any length are cut, with
    what follows the cut; a document's other columns are not read. Empty tables give empty ones.
    """
    ship(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    cut = written(read.mapInArrow(_shards(shard_words, slice_bytes), SHARDS))
    sizes = cut.filter("part = 0").select("shard", "lang", "n")
    totals = written(sizes.groupBy("lang").agg(F.sum("n").alias("n")))
    least = F.expr(f"greatest(1, ({support} * n + __all - 1) div greatest(1, __all))").alias("least")
    shares = written(sizes.join(totals.withColumnRenamed("n", "__all"), "lang").select("shard", least))

    distinct = cut.join(shares, "shard").select("shard", "part", "least", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    numbers = _number(F.col("shard"), F.col("part") * CHUNK + F.col("at")).alias("number")
    words = _frequent(distinct.select(numbers, "lang", F.col("x.words").alias("phrase"), F.col("x.counts").alias("count"), "least"), ["lang", "phrase"], support)

    def opened(table: DataFrame) -> DataFrame:
        """Rows go to the task of their group whole and are opened there."""
        dealt = table.select("least", "group", _number(F.col("shard"), F.col("start")).alias("start"), "heads", "tails", "counts").repartition("group")
        keys = dealt.select("least", "group", "start", F.posexplode(F.arrays_zip("heads", "tails", "counts")).alias("at", "x"))
        return keys.select((F.col("start") + F.col("at")).alias("number"), "group", F.col("x.heads").alias("head"), F.col("x.tails").alias("tail"), F.col("x.counts").alias("count"), "least")

    f = F.array("f")
    none = F.lit(None).cast("long")
    levels = [_firsts(words).select("lang", "id", "phrase", F.col("phrase").alias("last"), "f", f.alias("heads"), f.alias("tails"), none.alias("head"), none.alias("tail"))]
    found, streams = words, cut
    for _ in range(1, longest):
        places = found.select(F.shiftright("number", 24).alias("shard"), (F.col("number") % (1 << 24)).alias("place"), "id", "f")
        left = streams.filter("part = 0").select("shard", "stream").join(shares, "shard")
        before, streams = streams, written(left.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(_longer(split, groups), PHRASES))
        discard(before)
        found = _frequent(opened(streams), ["head", "tail", "group"], support)
        below = levels[-1]
        head = below.select("lang", F.col("id").alias("head"), F.col("phrase").alias("__phrase"), F.col("heads").alias("__heads"))
        tail = below.select(F.col("id").alias("tail"), F.col("last").alias("__last"), F.col("tails").alias("__tails"))
        level = _firsts(found).join(head, "head").join(tail, "tail")
        levels.append(written(level.select("lang", "id", F.concat_ws(" ", "__phrase", "__last").alias("phrase"), F.col("__last").alias("last"), "f", F.concat("__heads", F.array("f")).alias("heads"), F.concat("__tails", F.array("f")).alias("tails"), "head", "tail")))
    discard(streams)
    return levels, totals


def _score(size: int) -> Column:
    """(score, cut, l, r) of the lowest-scoring cut, the first of equals. Decimals hold the products."""
    cuts = []
    for k in range(1, size):
        l, r = f"heads[{k - 1}]", f"tails[{size - k - 1}]"
        score = F.expr(f"({SCALE} * cast(f as decimal(20,0))) div (cast({l} as decimal(20,0)) + cast({r} as decimal(20,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("cut"), F.expr(l).alias("l"), F.expr(r).alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, keep: int = KEEP, text_col: str = "text", lang_col: str = "lang", **cut) -> DataFrame:
    """The ``keep`` best phrases of 2 to ``longest`` words of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a`` (its
    occurrences), ``l`` and ``r`` (those of its parts at the lowest-scoring cut), ``n`` (words of the language), ``score``.

    A phrase goes if a longer frequent one around it has ``COVERED`` hundredths or more of its occurrences. Nulls, long texts and
    repeated rows as in ``phrase_counts``; ties in score go by occurrences, then by the phrase's bytes; empty tables give no
    rows; languages without a frequent phrase give none.
    """
    levels, totals = phrase_counts(docs, support, longest, text_col, lang_col, **cut)
    kept = []
    for size, level in enumerate(levels[1:], start=2):
        one = level.select("lang", "id", "phrase", F.col("f").alias("a"), _score(size).alias("s"))
        if size < longest:
            # A phrase further out has fewer occurrences than the one between: looking one word further is enough.
            longer = levels[size].select("f", F.explode(F.array_distinct(F.array("head", "tail"))).alias("id")).groupBy("id").agg(F.max("f").alias("__longest"))
            one = one.join(longer, "id", "left").filter(F.coalesce(100 * F.col("__longest") < COVERED * F.col("a"), F.lit(True)))
        kept.append(one.select("lang", "phrase", "a", "s.l", "s.r", "s.score"))
    all_ = kept[0]
    for more in kept[1:]:
        all_ = all_.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(PARTS))).orderBy(*order)
    best = all_.withColumn("__part", F.row_number().over(parts)).filter(F.col("__part") <= keep).drop("__part")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
