"""Search progress against a plain walk over the log, and as a stream that is interrupted."""

import random
import time
from datetime import date, timedelta

import pytest

from ledgerloom.operators import progress
from ledgerloom.streaming import progress as stream

RUNS = "source string, run long, today date, automatic boolean, since date, until date, ok boolean, own date, floor date"
D0, DAY = date(2024, 1, 1), timedelta(1)


def walk(runs):
    known, hole, hole_end, out = {}, {}, {}, []
    for s, run, today, automatic, since, until, ok, own, floor in sorted(set(runs), key=lambda r: (r[0], r[1])):
        cut = False
        if automatic:
            since = known[s] - 3 * DAY if known.get(s) else own
            bound = today - 90 * DAY
            cut = since < bound
            if cut:
                end = max(hole_end[s], bound - DAY) if hole.get(s) else bound - DAY
                hole[s], hole_end[s] = min(hole[s], since) if hole.get(s) else since, end
                since = bound
        if ok:
            until = min(until, today)
            k = known.get(s)
            if cut or (since <= k + DAY if k else since <= own <= until):
                known[s] = until if cut or not k else max(k, until)
            elif not k:
                known[s] = min(own + 3 * DAY, today)
            if hole.get(s):
                first = max(hole[s], floor) if floor else hole[s]
                if since <= first <= until:
                    hole[s], hole_end[s] = (None, None) if until >= hole_end[s] else (until + DAY, hole_end[s])
        out.append((s, run, since, known.get(s), hole.get(s), hole_end.get(s)))
    return sorted(out, key=lambda r: r[:2])


def log(seed, n=400):
    r = random.Random(seed)
    out, today, down = [], D0, {}
    for i in range(n):
        today += timedelta(r.choice([0, 0, 1, 1, 2, 9]))
        s = r.choice("abc")
        if r.random() < 0.02:
            down[s] = today + timedelta(r.choice([10, 130]))
        by_hand = r.random() < 0.25
        since = today - timedelta(r.randrange(0, 500))
        own = D0 - timedelta(40 * "abc".index(s))
        out.append((s, i, today, not by_hand, since if by_hand else None, since + timedelta(r.randrange(0, 480)) if by_hand else today, today > down.get(s, D0 - DAY) and r.random() < 0.8, own, D0 + 100 * DAY if s == "b" else None))
    return out + out[:5]


def rows(df):
    return sorted((tuple(r) for r in df.select("source", "run", "since", "searched_until", "hole_from", "hole_until").collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_steps(spark, seed):
    runs = log(seed)
    want = walk(runs)
    assert rows(progress.steps(spark.createDataFrame(runs, RUNS).repartition(4))) == want
    assert any(r[4] for r in want) and any(a[4] and not b[4] for a, b in zip(want, want[1:], strict=False) if a[0] == b[0])
    half = [r for r in runs if r[1] < 200], [r for r in runs if r[1] >= 200]
    first = progress.steps(spark.createDataFrame(half[0], RUNS))
    assert rows(first) + rows(progress.steps(spark.createDataFrame(half[1], RUNS), progress.last(first))) != [] and sorted(rows(first) + rows(progress.steps(spark.createDataFrame(half[1], RUNS), progress.last(first))), key=lambda r: r[:2]) == want
    assert progress.steps(spark.createDataFrame([], RUNS)).count() == 0


def test_a_stream_that_is_interrupted_says_the_same(spark, tmp_path, monkeypatch):
    runs = log(7, 120)[:120]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame(runs[40 * n : 40 * n + 40], RUNS).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    open_ = lambda: spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(source)
    last, seen = progress.last, []

    def fails_once(done):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("an executor too many")
        return last(done)

    monkeypatch.setattr(progress, "last", fails_once)
    with pytest.raises(Exception, match="too many"):
        stream.advance(open_(), folder)
    stream.advance(open_(), folder)
    assert rows(spark.read.parquet(f"{folder}/steps")) == walk(runs) and len(seen) == 4
    states = spark.read.parquet(f"{folder}/states")
    assert states.select("source").distinct().count() == 3
