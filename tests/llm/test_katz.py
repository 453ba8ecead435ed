"""Katz scores against the plain recursion."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import katz
from ledgerloom.sources.tables import table


def brute(rows):
    tokens = [((t or "").encode().lower().split() + [b""]) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for x, out in zip(tokens, held, strict=True):
        if not out:
            uni.update(x)
            bi.update(zip([b"", *x], x, strict=False))
    total, words = sum(uni.values()), len(uni)
    of = lambda c: [sum(1 for n in c.values() if n == r) for r in range(1, katz.LARGE + 2)]
    d1, d2 = katz.discounts(of(uni)), katz.discounts(of(bi))
    disc = lambda n, d: n * (d[n] if n <= katz.LARGE else 1.0)
    left = 1 - sum(disc(n, d1) for n in uni.values()) / (total + 1)
    p1 = lambda w: disc(uni[w], d1) / (total + 1) if uni[w] else left
    after = defaultdict(list)
    for (h, w), n in bi.items():
        after[h].append((w, n))

    def p2(w, h):
        if not uni[h]:
            return p1(w)
        if bi[h, w]:
            return disc(bi[h, w], d2) / (uni[h] + 1)
        alpha = (1 - sum(disc(n, d2) for _, n in after[h]) / (uni[h] + 1)) / (1 - sum(p1(x) for x, _ in after[h]))
        return alpha * p1(w)

    for h in [b"", *list(uni)[:5]]:
        assert sum(p2(w, h) for w in uni) + p2(b"\0never", h) == pytest.approx(1)
    for (i, _), x, out in zip(rows, tokens, held, strict=True):
        yield i, out, len(x), sum(uni[w] > 0 for w in x), total, sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (words + 1))) for w in x), sum(math.log10(p2(w, h)) for h, w in zip([b"", *x], x, strict=False))


def same(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in want]


@pytest.mark.parametrize("block,bucket", [(3_000_000, 1_500_000), (500, 4000)])
def test_scores(spark, awkward, empty, data_dir, block, bucket):
    docs = table(spark, data_dir, "documents").limit(80)
    same(katz.score_documents(docs, block=block, bucket=bucket).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    same(katz.score_documents(awkward, block=block, bucket=bucket).collect(), [(r.doc_id, r.text) for r in awkward.collect()])
    if block > 500:
        assert katz.score_documents(empty).count() == 0
        none = awkward.filter("crc32(cast(doc_id as string)) % 5 = 1")
        assert {r.train_tokens for r in katz.score_documents(none).collect()} == {0}


def test_discounts():
    d = katz.discounts([1000, 300, 140, 80, 50, 35])
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:]) and list(d[1:]) == sorted(d[1:])
    n = np.array([1000, 300, 140, 80, 50, 35.0])
    assert sum((1 - d[r]) * r * n[r - 1] for r in range(1, 6)) == pytest.approx(n[0])
    assert all(0 < x < 1 for x in katz.discounts([0, 0, 0, 0, 0, 0])[1:])


def test_tables_hold_the_model(spark, awkward):
    """Counts and alphas as stored, and scores that are read from them, against plain counters; new texts are scored, too."""
    docs = awkward.filter("text is null or length(text) < 6000")
    scores, model = katz.fit_and_score(docs, block=700, bucket=900)
    uni, bi = Counter(), Counter()
    for r in docs.collect():
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1:
            x = [*(w.decode() for w in (r.text or "").encode().lower().split()), ""]
            uni.update(x)
            bi.update(zip(["", *x], x, strict=False))
    key = lambda *words: F.xxhash64(*(F.xxhash64(F.lit(w)) for w in words)) if len(words) > 1 else F.xxhash64(F.lit(words[0]))
    got = {(r.order, r.gram): r.n for r in model.ngrams.collect()}
    some = [(w,) for w in list(uni)[:40]] + list(bi)[:40]
    keys = spark.range(1).select(*(key(*w).alias(str(i)) for i, w in enumerate(some))).first()
    assert len(got) == len(uni) + len(bi) and sum(n for (o, _), n in got.items() if o == 1) == model.total and model.words == len(uni)
    assert all(got[len(w), k] == (uni[w[0]] if len(w) == 1 else bi[w]) for w, k in zip(some, keys, strict=True))
    of = lambda rows: Counter((i, round(x, 6)) for i, x in rows)
    by_tables = katz.score_by_tables(docs.withColumn("row", F.lit("clash")), model).select("row.doc_id", "score").collect()
    assert of(by_tables) == of((r.doc_id, r.score) for r in scores.collect())
    new = spark.createDataFrame([("never such words",), (None,), ("the the never",)], "text string")
    assert all(r.score < 0 for r in katz.score_by_tables(new, model).collect())
    # A context's probabilities, with that of the unseen event, add up to 1: the text "h w" less the end after w and h itself.
    h = max(uni, key=lambda w: uni[w] if w else 0)
    d1, d2 = model.discounts
    disc = lambda n, d: n * (d[n] if n <= katz.LARGE else 1.0)
    names = {r.gram: r.name for r in model.ngrams.filter("order = 1").collect()}
    alphas = {r.name: r.alpha for r in model.alphas.collect()}
    alpha = alphas[names[spark.range(1).select(key(h)).first()[0]]]
    p1 = {w: disc(n, d1) / (model.total + 1) for w, n in uni.items()}
    assert sum(disc(bi[h, w], d2) / (uni[h] + 1) if bi[h, w] else alpha * p1[w] for w in uni) + alpha * model.left == pytest.approx(1, abs=1e-12)
