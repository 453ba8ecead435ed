"""Repeated strings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import suffixes


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    for n in (1, 2, 3, 50, 700):
        for k in (1, 2, 4, 200):
            x = r.integers(0, k, n)
            x = np.concatenate([x, x[: n // 2], np.zeros(seed * 3, int), x]) if n > 3 else x
            s = np.append(x + 1, 0)
            t = s.tolist()
            assert suffixes.suffix_array(s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            assert suffixes._rank_by_doubling(s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_deep_recursion():
    r = np.random.default_rng(1)
    words = [r.integers(1, 27, 4) for _ in range(6)]
    s = np.append(np.concatenate([words[i] for i in r.integers(0, 6, 4000)]), 0)
    sa = suffixes.suffix_array(s)
    b = s.astype(np.uint8).tobytes()
    assert sorted(sa.tolist()) == list(range(len(b)))
    assert all(b[i:] < b[j:] for i, j in zip(sa, sa[1:], strict=False))


def brute(texts):
    data = [(t or "").encode() for t in texts]
    where = defaultdict(list)
    for i, d in enumerate(data):
        for p in range(len(d) - 199):
            where[d[p : p + 200]].append((i, p))
    gone = [np.zeros(len(d), bool) for d in data]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + 200] = True
    for d, g in zip(data, gone, strict=True):
        n = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        yield len(d), int(g.sum()), n, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~g])).hexdigest()


@pytest.mark.parametrize("shard,hot", [(6_000_000, 20_000), (20_000, 20_000), (50_000, 3)])
def test_remove_repeats(spark, awkward, empty, shard, hot):
    r = np.random.default_rng(3)
    text = lambda n: "".join(r.choice(list("abcdé ø"), n))
    shared = [text(150), text(199), text(230), text(900)]
    more = [text(300) + s + text(40) + shared[(i + 1) % 4] + text(500) for i, s in enumerate(shared * 4)]
    more += [more[0][:700], more[0][5:], shared[2], shared[2] * 3, "ab" * 300, "z" * 199, "z" * 200, "y" * 201]
    docs = awkward.filter("doc_id is null or length(text) < 6000").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.collect()
    want = Counter((x.doc_id, *y) for x, y in zip(rows, brute([x.text for x in rows]), strict=True))
    got = suffixes.remove_repeats(docs, shard=shard, hot=hot).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    if hot == 3:
        assert suffixes.remove_repeats(empty).count() == 0
