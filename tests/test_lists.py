"""A store's list and its replay, against one pair of store and article at a time."""

import math
import random
import statistics
from collections import defaultdict
from datetime import date, timedelta

import pytest

from ledgerloom.operators import replay

D0 = date(2024, 1, 1)
DAY = timedelta(1)


class Plain:
    def __init__(self, buys, sold, returned, season):
        self.season, self.buys, self.here, self.visits = season, defaultdict(float), defaultdict(set), defaultdict(set)
        for s, a, d, q in buys:
            if d <= season.today:
                self.buys[a, d] += q
                self.here[s, a].add(d)
                self.visits[s].add(d)
        self.sold, self.back = defaultdict(list), defaultdict(list)
        for table, rows in ((self.sold, sold), (self.back, returned)):
            for a, d, q in rows:
                if d <= season.today:
                    table[a].append((d, q))

    def score(self, s, a, day, stop):
        z = self.season
        days = sorted(d for x, d in self.buys if x == a and d < stop)
        here = sorted(d for d in self.here[s, a] if d < stop)
        if not days or not here:
            return None
        past = stop <= day
        covered = None if z.covered_until is None else min(z.covered_until, stop - DAY) if past else z.covered_until
        ref = min(z.ref_day, stop - DAY) if past else z.ref_day
        fresh = covered is not None and (ref - covered).days <= 3
        visits = sorted(v for v in self.visits[s] if v < stop)
        last31 = visits[-31:]
        gaps = [(b - c).days for c, b in zip(last31, last31[1:], strict=False)]
        gap = statistics.median(gaps) if len(gaps) >= 2 else 14.0
        w = lambda d: 0.5 ** ((day - d).days / 180)
        habit = (sum(map(w, here)) + 0.1) / (sum(w(v) for v in visits if v >= days[0]) + 1)
        q = lambda d: self.buys[a, d]
        sold = lambda lo, hi: sum(x for d, x in self.sold[a] if lo <= d < min(hi, day))
        rate = lambda rows, lo, hi: sum(x * 0.5 ** ((hi - DAY - d).days / 90) for d, x in rows if lo <= d < hi) / sum(0.5 ** (i / 90) for i in range((hi - lo).days)) if hi > lo else None
        need = clock = None
        start = max(z.till_start, day - timedelta(365)) if z.till_start and z.till_start < day else None
        end = None if covered is None else min(day, covered + DAY)
        ever = sum(x for d, x in self.sold[a] if d < day)
        if len(days) >= 3:
            late = [d for d in days if start and d >= start]
            inside = [d for d in late if end and d < end]
            if start and end and ever > 0 and len(late) >= 3 and len(inside) >= 3:
                poured = sold(inside[0], inside[-1])
                k = sum(map(q, inside[:-1])) / poured if poured > 0 else 0
                if 0.25 <= k <= 5 and q(days[-1]) > 0:
                    if fresh:
                        r, used = rate(self.sold[a], start, day) or 0.0, sold(days[-1], day)
                    else:
                        r = rate(self.sold[a], start, end) or 0.0
                        used = sold(days[-1], end) + r * max(0, (day - max(end, days[-1])).days)
                    need, clock = k * (max(0.0, used) + r * gap) / q(days[-1]), "till"
            if clock is None:
                r = rate([(d, q(d)) for d in days], days[0], day)
                if r and q(days[-1]) > 0:
                    need, clock = ((day - days[-1]).days + gap) / (q(days[-1]) / r), "calendar"
        back, bought = sum(x for d, x in self.back[a] if d < stop), sum(map(q, days))
        status = "deposit" if back > 0 and bought > 0 and back >= bought / 2 else "elsewhere" if len(days) >= 3 and not set(days[-3:]) & set(here) else "ok"
        p = min(max(habit, 1e-4), 1 - 1e-4)
        chance = 1 / (1 + math.exp(-(math.log(p / (1 - p)) + 0.39 + (0.82 * math.log(min(max(need, 0.1), 2)) if need is not None else 0) - (2 if len(days) < 3 else 0))))
        still = end is not None and ever > 0 and sold(end - timedelta(30), end) > 0
        return {"habit": habit, "need": need, "clock": clock, "chance": chance, "status": status, "days": days, "here": here, "still": still}

    def plan(self):
        out, today = {}, self.season.today
        for (s, a), bought in self.here.items():
            now = self.score(s, a, today, today + DAY)
            visits = sorted(self.visits[s])[::-1][:5]
            insisted = None
            if now["status"] == "ok" and now["chance"] >= 0.25:
                k = 3 if 1 / (1 + math.exp(-(math.log(now["habit"] / (1 - now["habit"])) + 0.39))) < 0.25 else 5
                then = [self.score(s, a, v, v) for v in visits[:k]]
                if len(then) == k and all(t and t["status"] == "ok" and t["chance"] >= 0.25 for t in then) and not bought & set(visits[:k]):
                    insisted = k
            days = now["days"]
            gaps = [(b - c).days for c, b in zip(days, days[1:], strict=False)]
            silent = None
            if now["status"] != "deposit" and len(days) >= 3 and (today - days[-1]).days > max(3 * statistics.median(gaps), 60):
                silent = "paused" if now["still"] else "dropped"
            year, c = (today - now["here"][-1]).days <= 365, now["chance"]
            if now["status"] != "ok":
                section = "deposit" if now["status"] == "deposit" else "elsewhere" if year else None
            elif insisted or 0.125 <= c < 0.25:
                section = "maybe"
            else:
                section = "buy" if c >= 0.25 else "new" if len(days) < 3 and (today - days[0]).days <= 90 else "quiet" if silent and year else None
            out[s, a] = (now["status"], now["clock"], silent, insisted, section, *(None if now[x] is None else round(now[x], 7) for x in ("habit", "need", "chance")))
        return out


def made(seed):
    r = random.Random(seed)
    day = lambda lo, hi: D0 + timedelta(r.randrange(lo, hi))
    buys, sold, returned = [], [], []
    for a in range(14):
        lo = r.choice([0, 0, 300, 560])
        hi = r.choice([450, 600, 620]) if lo < 500 else 620
        for _ in range(r.choice([1, 2, 4, 15, 40])):
            buys.append((r.randrange(3) if a % 4 else a % 3, f"a{a}", day(lo, hi), float(r.choice([0, 1, 2, 6]) if r.random() < 0.2 else 4)))
        if a % 3:
            sold += [(f"a{a}", day(200, 612), r.choice([-1.0, 0.5, 1.0, 3.0])) for _ in range(60)]
        if a % 5 == 4:
            returned += [(f"a{a}", day(0, 620), 9.0) for _ in range(4)]
    for s in range(3):
        buys += [(s, "bread", D0 + timedelta(i), 1.0) for i in range(s, 615, 9 + 5 * s)]
        # Bought at every visit, then never again.
        buys += [(s, f"left{s}", D0 + timedelta(i), 2.0) for i in range(s, 520, 9 + 5 * s)]
    return buys, sold, returned


@pytest.mark.parametrize("seed,till,covered", [(1, 150, 609), (2, 150, 560), (3, None, None)])
def test_plan(spark, seed, till, covered):
    buys, sold, returned = made(seed)
    at = lambda n: None if n is None else D0 + timedelta(n)
    season = replay.Season(at(612), at(till), at(covered), at(611))
    b = spark.createDataFrame(buys, "store long, article string, day date, quantity double").repartition(5)
    t, back = (spark.createDataFrame(x, "article string, day date, quantity double").repartition(3) for x in (sold, returned))
    want = Plain(buys, sold, returned, season)
    got = {(r.store, r.article): (r.status, r.clock, r.silent, r.insisted, r.section, *(None if x is None else round(x, 7) for x in (r.habit, r.need, r.chance))) for r in replay.plan(b, b, t, back, season).collect()}
    expected = want.plan()
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key][:5] == row[:5] and got[key][5:] == pytest.approx(row[5:], abs=1e-6), key
    assert len({x[4] for x in expected.values()}) > 3 and (covered is not None or "till" not in {x[1] for x in expected.values()})
    listed = b.select("store", "article").distinct()
    for r in replay.replayed(listed, b, b, t, back, season).collect():
        then = want.score(r.store, r.article, r.day, r.day)
        assert (r.status, r.clock) == (then["status"], then["clock"]) and (r.chance, r.habit) == pytest.approx((then["chance"], then["habit"]), abs=1e-7)


def test_empty(spark):
    season = replay.Season(D0, None, None, D0)
    b = spark.createDataFrame([], "store long, article string, day date, quantity double")
    t = spark.createDataFrame([], "article string, day date, quantity double")
    assert replay.plan(b, b, t, t, season).count() == 0
