"""Language ID, near duplicates and BPE against brute force, and the pipeline end to end."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from ledgerloom.llm import bpe, language, neardup
from ledgerloom.sources.tables import table


def brute_bits(text, lang_counts, kept, seen, order):
    """Code length by the plain recursion, one symbol at a time."""
    data, total = text.encode(), 0.0
    for i, s in enumerate(data):
        done, p = set(), 1.0
        d = min(order, i)
        while d and data[i - d : i] not in kept:
            d -= 1
        for k in range(d, -1, -1):
            c = {x: n for x, n in lang_counts[data[i - k : i]].items() if x not in done}
            n, q = sum(c.values()), len(c)
            if not n:
                continue
            if s in c:
                p *= c[s] / (n + q)
                break
            p *= q / (n + q)
            done |= set(c)
        else:
            p /= 256 - len(done)
        total -= math.log2(p)
    return total


def test_language_code_lengths(spark):
    train = [("en", "the cat and the hat"), ("en", "that is the thing"), ("fr", "le chat et la chatte"), ("fr", "été là")]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string")
    for limit in (10_000, 25):
        model = language.train(df, order=3, max_contexts=limit)
        counts = {x: defaultdict(Counter) for x in ("en", "fr")}
        total = Counter()
        for x, t in train:
            b = t.encode()
            for k in range(4):
                for i in range(k, len(b)):
                    counts[x][b[i - k : i]][b[i]] += 1
                    total[b[i - k : i]] += 1
        order = sorted(total, key=lambda c: (-total[c], len(c), int.from_bytes(c, "big")))[:limit]
        texts = ["the chat", "là où", "", "zzz \U0001f600", "that and the " * 100]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        got = language.code_lengths(model, data, offsets)
        for i, t in enumerate(texts):
            for j, x in enumerate(model.languages):
                assert got[i, j] == pytest.approx(brute_bits(t, counts[x], set(order), None, 3), rel=1e-4)


def test_language_of_documents(spark, awkward, empty, data_dir):
    got = language.language_of_documents(table(spark, data_dir, "documents")).join(table(spark, data_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    right = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(right) > 20 and sum(right) >= 0.97 * len(right)
    odd = language.language_of_documents(awkward).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert Counter(r.lang_pred == "und" for r in odd)[True] == awkward.filter("text is null or not text rlike '\\\\p{L}'").count()
    assert language.language_of_documents(empty).count() == 0
    assert {r.lang_pred for r in language.identify(awkward, None).collect()} == {"und"}
    assert language.with_language(awkward).select("row.*").columns == awkward.columns


def test_language_query_is_the_plain_recursion(spark, awkward):
    """Drawing (all of so little), kept contexts, code lengths, share and verdict, one text at a time."""
    rows = [r for r in awkward.collect() if len(r.text or "") < 6000]
    docs = spark.createDataFrame(rows, awkward.schema)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    counts = defaultdict(lambda: defaultdict(Counter))
    for _, lang, text in sorted({(r.doc_id or -1, r.lang, r.text) for r in rows if r.lang and r.text and not out(r.doc_id)}, key=str):
        b = text.encode()
        for x in (b[i : i + language.DRAWN] for i in range(0, len(b), language.DRAWN)):
            for k in range(language.ORDER + 1):
                for i in range(k, len(x)):
                    counts[lang][x[i - k : i]][x[i]] += 1
    key = lambda c: (len(c), int.from_bytes(c, "big"))
    own = {x: {c: sum(n.values()) for c, n in v.items()} for x, v in counts.items()}
    total = Counter()
    for v in own.values():
        total.update(v)
    top = set(sorted(total, key=lambda c: (-total[c], *key(c)))[: language.MAX_CONTEXTS])
    kept = {x: (top & set(v)) | set(sorted(v, key=lambda c: (-v[c], *key(c)))[: language.MAX_CONTEXTS // 4]) | {b""} for x, v in own.items()}
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in language.language_of_documents(docs).collect())
    want = Counter()
    for r in rows:
        pred, score = "und", 0.0
        if any(c.isalpha() for c in r.text or ""):
            bits = {x: brute_bits(r.text, counts[x], kept[x], None, language.ORDER) for x in sorted(counts)}
            pred = min(bits, key=lambda x: bits[x])
            score = 1 / sum(2.0 ** max(-1000, bits[pred] - b) for b in bits.values())
        want[r.doc_id, out(r.doc_id), pred, round(score, 4)] += 1
    assert got == want and len(own) == 2


def test_many_languages_stay_bounded(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * (20 + i), f"l{i:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "MAX_LANGUAGES", 40)
    monkeypatch.setattr(language, "MODEL_BYTES", 3_000_000)
    model = language.train(df)
    assert model.languages == tuple(f"l{i:03d}" for i in range(20, 60)) and model.nbytes <= 3_000_000


def test_language_sample_fills_its_bytes(spark):
    long = lambda i: "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(100_000))
    rows = [(i, long(i), "few") for i in range(4)] + [(100 + i, f"text number {i}", "many") for i in range(3000)] + [(9000, "petit", "one")]
    df = spark.createDataFrame([*rows, *rows[:2]], "id long, text string, lang string").repartition(4)
    languages, sample = language._drawn(df, 20_000)
    got = {r.lang: (r.n, r.most) for r in sample.groupBy("lang").agg(language.F.sum(language.F.octet_length("text")).alias("n"), language.F.max(language.F.octet_length("text")).alias("most")).collect()}
    assert languages == ("few", "many", "one") and got["one"][0] == 5
    assert all(20_000 <= got[x][0] <= 20_000 * 1.2 for x in ("few", "many")) and got["few"][1] <= language.DRAWN


def test_small_language_keeps_its_contexts(spark):
    big = [(i, " ".join(f"{(i * 31 + j) * 7919 % 9973}" for j in range(400)), f"l{i % 3}") for i in range(60)]
    df = spark.createDataFrame([*big, (1000, "quux " * 4, "small")], "doc_id long, text string, lang string")
    model = language.train(df, max_contexts=200)
    text = b"quux quux quux "
    bits = language.code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    small = model.languages.index("small")
    assert len(model.trees[small].bits) >= 20 and bits.argmin() == small and bits[small] < 25


def brute_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_near_duplicates(spark, awkward, empty):
    got = neardup.near_duplicates(awkward).collect()
    rows = awkward.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(set(fps))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r.doc_id is not None:
            least[roots[f]] = min(r.doc_id, least.get(roots[f], r.doc_id))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r.doc_id, f"{f:016x}", least.get(roots[f])) for r, f in zip(rows, fps, strict=True))
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.one_of_each_group(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(roots[f] for f in fps))


@pytest.mark.parametrize("leaf,block", [(48, 4096), (3, 4096), (3000, 64)])
def test_links_find_every_component(spark, leaf, block):
    r = np.random.default_rng(5)
    fps = list(r.integers(0, 1 << 63, 400, dtype=np.int64))
    for f in fps[:120]:
        x = int(f)
        for _ in range(4):
            for b in r.integers(0, 64, r.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x - (1 << 64) if x >= 1 << 63 else x)
            x &= (1 << 64) - 1
    fps = sorted({int(x) for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in neardup.components(neardup.links(df, leaf, block)).collect()}
    want = brute_components({x & ((1 << 64) - 1) for x in fps})
    group = lambda f: got.get(f, f)
    by_got, by_want = defaultdict(set), defaultdict(set)
    for x in fps:
        by_got[group(x)].add(x)
        by_want[want[x & ((1 << 64) - 1)]].add(x)
    assert {frozenset(v) for v in by_got.values()} == {frozenset(v) for v in by_want.values()}


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (64, 16), (3000, 20)])
def test_bpe(spark, awkward, empty, chunk, overlap):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = awkward.unionByName(spark.createDataFrame([(3000, "it's we'll   \n\n  they've 12,345!! " * 400), (3001, "　 é" * 999), (3002, " " * 700 + "x"), (3003, "<|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True)

    def want(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = bpe.encode(docs, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r.doc_id, *want(r.text)) for r in docs.collect())
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap, with_ids=True)
    back = bpe.decode(coded.withColumnsRenamed({"ids_sha256": "row", "decoded_sha256": "raw"}), path).collect()
    assert Counter((r.row.doc_id, bytes(r.raw)) for r in back) == Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert Counter((r.row.doc_id, bytes(r.row.ids)) for r in back) == Counter((r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in docs.collect())


def test_decode_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, None), (2, b"")], "k long, ids binary")
    assert {r.row.k: r.raw for r in bpe.decode(rows, path).collect()} == {1: None, 2: b""}
    assert bpe.decode(rows.limit(0), path).count() == 0
    with pytest.raises(Exception, match="no token has"):
        bpe.decode(spark.createDataFrame([(b"\xff\xff\xff\x00",)], "ids binary"), path).collect()
