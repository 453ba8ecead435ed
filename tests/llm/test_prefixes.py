"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import prefixes

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[r[0]].append((r[1] is not None, r[1] or 0, role.encode(), key, (role, text)))
    turns = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def rows(seed=1, n=120):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", None, ""], ["a", "b", "é", "", None, "user", "long text " * 20]
    out = []
    for c in r.sample(range(-20, 10 * n), n):
        head = [("user", "hello"), ("assistant", "hi")] if r.random() < 0.6 else []
        body = [(r.choice(roles), r.choice(texts)) for _ in range(r.choice([0, 0, 1, 2, 3, 5, 12]))]
        out += [(c, t, *x) for t, x in enumerate(head + body)] or [(c, None, None, None)]
    for c in range(5000, 5400):
        out += [(c, 0, "user", "hello"), (c, 1, "assistant", "hi"), (c, 2, "user", "x")]
    out += [(None, 0, "user", "of none"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "b", "tie"), (7, None, "user", "first"), (2**62, 0, "user", "hello")]
    r.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(*x, "clash", 1) for x in data], "conv_id long, turn long, role string, text string, key string, n long").repartition(5)


def table(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes", [10_000_000, 3000, 300])
def test_trie(spark, shard_bytes):
    data = rows()
    assert table(prefixes.conversation_trie(frame(spark, data), shard_bytes)) == sorted(brute(data), key=str)


def test_small_and_empty(spark):
    assert prefixes.conversation_trie(frame(spark, []), 100).count() == 0
    for data in ([(1, 0, "user", "only one")], [(4, 0, None, None)], [(c, 0, "u", "t") for c in range(30)], [(None, 1, "a", "b")]):
        assert table(prefixes.conversation_trie(frame(spark, data), 100)) == sorted(brute(data), key=str)


def test_minima():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        x = r.integers(0, 4, n)
        m = prefixes.Minima(x)
        lo = r.integers(0, n, 50)
        hi = np.array([r.integers(a, n) for a in lo])
        assert (m.over(lo, hi) == [x[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]).all()
        x[0] = -1
        m, least = prefixes.Minima(x), r.integers(0, 4, 50)
        right, left = m.right(lo, least), m.left(lo, least)
        for a, d, to, since in zip(lo, least, right, left, strict=True):
            assert (x[a + 1 : to + 1] >= d).all() and (to == n - 1 or x[to + 1] < d)
            assert (x[since + 1 : a + 1] >= d).all() and x[since] < d
