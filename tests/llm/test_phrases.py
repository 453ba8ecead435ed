"""Phrase mining against counting every phrase."""

import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import phrases

FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, support, keep):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if a >= support and len(x[1]) > 1}
    inside = {(lang, p[i:j]) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[lang, p[i:j]]}
    by = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, x in by.items() for rank, (score, a, p, l, r) in enumerate(sorted(x)[:keep], 1)}


@pytest.mark.parametrize("support,keep,cut", [(3, 2000, {}), (2, 5, {"shard_words": 150, "slice_bytes": 64, "split": 7}), (30, 2000, {"shard_words": 1000, "slice_bytes": 300})])
def test_phrases(awkward, support, keep, cut):
    got = phrases.collocations(awkward, support, keep=keep, **cut).collect()
    want = brute([(r.lang, r.text) for r in awkward.collect()], support, keep)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_ties_pieces_and_empty(spark, empty):
    rows = [("a b. c", None)] * 30 + [("A\tb\x0bc", "x")] * 31 + [("b  a", "x")] * 31 + [("a b", "x")] * 29
    docs = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in rows], "text string, lang string, phrase string, shard long").repartition(7)
    got = {tuple(r) for r in phrases.collocations(docs).collect()}
    assert got == brute([(lang, t) for t, lang in rows], 30, 2000)
    assert {(r[0], r[2]) for r in got} == {("und", "a b"), ("x", "a b"), ("x", "b a")}
    assert phrases.collocations(empty).count() == 0


def test_slices_keep_every_start():
    text = b"a b c d e f g h\xffi j " + b"k" * 50 + b" l m n o p"
    for size in range(1, 40):
        starts = []
        for words, own in phrases._slices(text, size):
            starts += [tuple(words[i : i + 4]) for i in range(own) if words[i] != b"\xff"]
        whole = text.replace(b"\xff", b" \xff ").split()
        cut = lambda x: tuple(x[: x.index(b"\xff")]) if b"\xff" in x else tuple(x)
        assert [cut(list(x)) for x in starts] == [cut(whole[i : i + 4]) for i in range(len(whole)) if whole[i] != b"\xff"]


def test_groups_and_split_rows(awkward, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 5)
    got = phrases.collocations(awkward, 2, keep=50, shard_words=150, slice_bytes=64, split=7, groups=3).collect()
    assert {tuple(r) for r in got} == brute([(r.lang, r.text) for r in awkward.collect()], 2, 50)


def test_rows_of_an_exchange(spark, monkeypatch):
    """However many heads are frequent, a shard sends a row a group, and what arrives is opened once."""
    frequent, written, keys, made = phrases._frequent, phrases.written, [], []

    def seen(table, *by):
        table = written(table, *by)
        if {"stream", "tails"} <= set(table.columns):
            made.append(table.count())
        return table

    monkeypatch.setattr(phrases, "written", seen)
    monkeypatch.setattr(phrases, "_frequent", lambda table, *more: keys.append(table) or frequent(table, *more))
    heads = 6000
    docs = spark.range(30 * heads).selectExpr(f"concat('h', id % {heads}, ' t') AS text", "'x' AS lang").repartition(3)
    levels, _ = phrases.phrase_counts(docs, longest=2)
    assert levels[1].count() == heads
    assert keys[-1]._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    assert len(made) == 1 and made[0] <= 3 * phrases.GROUPS < heads
