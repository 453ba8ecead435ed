"""The passes that settle payments, against one plain loop over everything."""

import datetime
import itertools
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from ledgerloom.operators import graph
from ledgerloom.plans import parties

PAYMENTS = "payment_id long, key long, day date, due decimal(12,2), card boolean, by_label boolean"
DOCUMENTS = "invoice_id long, key long, invoice_day date, total decimal(12,2), fresh boolean"


def plain(payments, documents, credit):
    """Each payment in order looks at every document that is left."""
    by = defaultdict(set)
    for p in payments:
        if p.due > 0:
            by[not p.card, p.day, p.payment_id, p.due, p.by_label].add(p.key)
    free = {d.invoice_id: d for d in documents if d.invoice_day and (d.total > 0 if credit else d.total != 0)}
    of = defaultdict(list)
    for d in free.values():
        of[d.key].append(d)
    out = set()
    for (no_card, day, payment, due, by_label), keys in sorted(by.items()):
        back, ahead = (180, 90) if credit else (180, 0) if no_card else (3, 1)
        near = [d for k in keys for d in of[k] if d.invoice_id in free and -ahead <= (day - d.invoice_day).days <= back]
        equal = sorted((abs((day - d.invoice_day).days), d.invoice_id) for d in near if d.total == due)
        take = []
        if len(equal) == 1:
            take = [equal[0][1]] if free[equal[0][1]].fresh and not by_label else []
        elif equal:
            take = [equal[0][1]] if not no_card and equal[0][0] < equal[1][0] else []
        elif not by_label:
            sums = []
            for key in keys:
                pool = sorted((d.invoice_day, d.invoice_id, d.total) for d in near if d.key == key and d.fresh)[-12:]
                sums += [c for n in (2, 3, 4) for c in itertools.combinations(pool, n) if sum(d[2] for d in c) == due]
            take = [d[1] for d in sums[0]] if len(sums) == 1 else []
        for i in take:
            del free[i]
            out.add((payment, i))
    return out


def made(spark, payments, documents, parts=5):
    return spark.createDataFrame(payments, PAYMENTS).repartition(parts), spark.createDataFrame(documents, DOCUMENTS).repartition(parts)


def some(seed, n_keys, n, days, amounts):
    r = random.Random(seed)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(r.randrange(days))
    payments, documents = [], []
    for i in range(n):
        row = (i, day(), Decimal(r.choice(amounts) * r.choice([1, 1, 2, 3])), r.random() < 0.3, r.random() < 0.1)
        payments += [(row[0], k, *row[1:]) for k in r.sample(range(n_keys), r.choice([1, 1, 1, 2]))]
        documents.append((i, r.randrange(n_keys), day() if r.random() < 0.95 else None, Decimal(r.choice(amounts)), r.random() < 0.8))
    return payments, documents + [(n + 1, 0, day(), Decimal(0), True), (n + 2, 0, day(), Decimal(-5), True)]


@pytest.mark.parametrize("credit", [False, True])
@pytest.mark.parametrize("shape", [(1, 12, 150, 900, [10, 15, 20, 25, 35, 50]), (2, 3, 120, 700, [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43]), (3, 40, 200, 2000, [101, 203, 307, 411, 512, 613])])
def test_settle(spark, shape, credit):
    p, d = made(spark, *some(*shape))
    got = {tuple(r) for r in (parties.settle_credits if credit else parties.settle_debits)(p, d).collect()}
    want = plain(p.collect(), d.collect(), credit)
    assert got == want and len(want) > 5
    assert shape[0] != 1 or max(sum(x == q for x, _ in want) for q, _ in want) > 1


@pytest.mark.parametrize("name,credit,sf", [("reconcile_debits", False, "sf0.01"), ("reconcile_credits", True, "sf0.001")])
def test_queries(spark, name, credit, sf):
    p, d = (parties._named_credits if credit else parties._named_payments)(spark, f"/root/testdata/{sf}")
    got = {tuple(r) for r in getattr(parties, name)(spark, f"/root/testdata/{sf}").collect()}
    want = plain(p.collect(), d.collect(), credit)
    assert got == want and want and (credit or len({x for x, _ in want}) < len(want))


def test_one_transfer_for_two_documents_and_what_is_taken(spark):
    day = datetime.date(2026, 6, 10)
    p = [(1, 1, day, Decimal(500), False, False), (2, 1, day + datetime.timedelta(2), Decimal(300), False, False), (3, 1, day + datetime.timedelta(3), Decimal(90), False, True)]
    d = [(1, 1, day - datetime.timedelta(20), Decimal(300), True), (2, 1, day - datetime.timedelta(5), Decimal(200), True), (3, 1, day, Decimal(90), True)]
    assert {tuple(r) for r in parties.settle_credits(*made(spark, p, d)).collect()} == {(1, 1), (1, 2)}
    assert parties.settle_credits(*made(spark, [], [])).count() == 0
    # A partly paid balance of the amount beside a fresh one: two exact ones, so none is sure.
    assert parties.settle_credits(*made(spark, p[:1], [(7, 1, day, Decimal(500), False), (8, 1, day, Decimal(500), True)])).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {n: find(n) for n in list(up) if find(n) != n}


def test_a_deposit_is_found_behind_many_small_documents(spark):
    from ledgerloom.operators import matching

    day = datetime.date(2026, 6, 10)
    d = [(1, 1, day - datetime.timedelta(1), Decimal(500), True)] + [(10 + n, 1, day + datetime.timedelta(2), Decimal("1.01"), True) for n in range(14)]
    d += [(50, 2, day, Decimal(70), True), (51, 3, day, Decimal(80), True), (52, 3, day, Decimal(80), False)]
    credits = [(1, 1, day, 100, False, False), (2, 2, day, 70, True, False), (3, 9, day, 70, False, False), (4, 9, day, 70, False, True), (5, 3, day, 80, False, False), (6, 2, day, 70, True, True)]
    credits = spark.createDataFrame([(*c[:3], Decimal(c[3]), *c[4:]) for c in credits], "payment_id long, key long, day date, due decimal(12,2), by_label boolean, recognised boolean")
    got = {tuple(r) for r in matching.credit_cascade(credits, spark.createDataFrame(d, DOCUMENTS)).collect()}
    assert got == {(1, "deposit", "to_confirm", 1, "1"), (2, "exact", "near_sure", 1, "50"), (3, "unnamed", "to_confirm", 1, "50"), (5, "several", "to_confirm", 2, "51"), (6, "exact", "near_sure", 1, "50")}
    assert matching.credit_cascade(credits, spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_a_payment_does_not_look_at_all_of_its_window(monkeypatch):
    import bisect
    import time

    import pandas as pd

    from ledgerloom.operators import settling

    r = random.Random(5)
    n, columns = 12_000, ["paying", "id", "key", "lo", "hi", "day", "cents", "card", "by_label", "fresh"]
    documents = [(False, i, 1, 0, 0, r.randrange(300), r.choice([700, 900, 1100]), False, False, True) for i in range(n)]
    payments = [(True, i, 1, day - 180, day, day, 700, False, False, True) for i in range(n) for day in [r.randrange(300)]]
    begun = time.process_time()
    # Several of the amount are always free, so no payment is sure.
    assert settling._in_order(pd.DataFrame(documents + payments, columns=columns)) == []
    assert time.process_time() - begun < 10
    pool = [(0, i, r.choice([-5, 3, 3, 7, 8]), True) for i in range(12)]
    every = sorted(c for size in (2, 3, 4) for c in itertools.combinations(pool, size) if sum(d[2] for d in c) == 10)
    assert sorted(settling._sets(pool, 10)) == every != []
    free = settling._Free()
    days = sorted(r.randrange(40) for _ in range(60))
    rows = [(d, i) for i, d in enumerate(days)]
    for row in rows:
        free.add(row)
    left = list(rows)
    for gone in r.sample(rows, 60):
        lo, hi = sorted(r.sample(range(-2, 45), 2))
        within = left[bisect.bisect_left(left, (lo,)) : bisect.bisect_left(left, (hi + 1,))]
        assert free.latest(lo, hi, 5) == within[::-1][:5] and free.earliest(lo, hi, 5) == within[:5]
        free.take(gone[1] + 1)
        left.remove(gone)
    assert free.latest(-9, 99, 5) == free.earliest(-9, 99, 5) == []
