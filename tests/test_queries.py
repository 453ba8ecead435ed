"""Every ledger query against its DuckDB twin, and the greedy ones against plain loops."""

import datetime
import decimal
import math
import random
from collections import defaultdict

import duckdb
import pytest

from ledgerloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.8g}"
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, data_dir, name):
    got = registry.QUERIES[name](spark, data_dir)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    a = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    b = sorted(tuple(map(plain, r)) for r in want.select(",".join(f'"{c}"' for c in columns)).fetchall())
    assert a == b


#: Queries that SQL cannot express, each held against plain loops: here or in test_whole.
LOOPED = {"reconcile_greedy", "products_resolved", "reconcile_debits", "reconcile_credits", "sold_attribution", "ocr_match", "payout_exact_runs", "slip_components"}


def test_every_query_has_a_twin_or_a_loop():
    assert set(registry.QUERIES) - set(registry.ORACLES) <= LOOPED


def test_reconcile_is_the_plain_pass(spark, data_dir):
    """All payments one after another, cards first, each looking at every invoice that is left."""
    from ledgerloom.plans import matching as plans

    p, i = (df.collect() for df in plans._read(spark, data_dir))
    # More of the same amount at the same payee than the data have.
    p += [type(p[0])(payment_id=10**6 + n, key=1, day=datetime.date(1995, 1, 1) + datetime.timedelta(days=11 * n), due=25, card=n % 3 == 0) for n in range(40)]
    i += [type(i[0])(invoice_id=10**6 + n, key=1, invoice_day=datetime.date(1995, 1, 2) + datetime.timedelta(days=7 * n), total=25, fresh=True) for n in range(50)]
    free, want = {x.invoice_id: x for x in i if x.invoice_day}, set()
    for x in sorted(p, key=lambda x: (not x.card, x.day, x.payment_id)):
        back, ahead = (3, 1) if x.card else (180, 0)
        near = sorted((abs((x.day - y.invoice_day).days), y.invoice_id) for y in free.values() if y.key == x.key and y.total == x.due and -ahead <= (x.day - y.invoice_day).days <= back)
        if len(near) == 1 or len(near) > 1 and x.card and near[0][0] < near[1][0]:
            want.add((x.payment_id, near[0][1]))
            del free[near[0][1]]
    df = lambda rows, like: spark.createDataFrame(rows, like.schema)
    like_p, like_i = plans._read(spark, data_dir)
    dec = lambda rows, c: [r.asDict() | {c: decimal.Decimal(r[c])} for r in rows]
    got = {(r.payment_id, r.invoice_id) for r in plans.matching.greedy(df(dec(p, "due"), like_p), df(dec(i, "total"), like_i)).collect()}
    assert got == want and len(want) > 15
    assert {(r.payment_id, r.invoice_id) for r in registry.QUERIES["reconcile_greedy"](spark, data_dir).collect()} == {x for x in want if x[0] < 10**6}


def test_attribution_serves_all_that_was_sold(spark, data_dir):
    from ledgerloom.plans import till

    served = defaultdict(int)
    for r in registry.QUERIES["sold_attribution"](spark, data_dir).collect():
        served[r.recipe_id, r.grp] += r.servings
    sold = {r.recipe_id: r.sold for r in till._sold(spark, data_dir).collect()}
    assert served and all(n == sold[recipe] for (recipe, _), n in served.items())


def test_attribution_is_the_plain_greedy_pass(spark, data_dir):
    """Lone options first; then whole servings within the loss, then within the room, then the rest to the dearest."""
    from ledgerloom.plans import till

    groups, used = defaultdict(list), {}
    for r in till._demands(spark, data_dir).collect():
        groups[r.pool, r.recipe_id, r.grp].append(r)
        used[r.product_id] = float(r.used)
    want = {}
    for key, options in groups.items():
        options.sort(key=lambda r: (-r.cost * float(r.amount), r.product_id))
        want |= {(*key, r.product_id): 0 for r in options}
        if len(options) == 1:
            want[*key, options[0].product_id] = options[0].sold
            used[options[0].product_id] += float(options[0].amount) * options[0].sold
    due = {k: o[0].sold for k, o in groups.items() if len(o) > 1}
    for strict in (True, False):
        for key in sorted(due):
            for r in groups[key]:
                a, room = float(r.amount), float(r.available) - used[r.product_id]
                n = math.floor(room / a + 1e-9) if room > 0 else 0
                if strict:
                    rest = float(r.available) * (1 - float(r.loss)) - used[r.product_id]
                    n = min(n, math.ceil(rest / a - 1e-9)) if rest > 0 else 0
                n = min(n, due[key])
                want[*key, r.product_id] += n
                used[r.product_id] += n * a
                due[key] -= n
    for key, n in due.items():
        want[*key, groups[key][0].product_id] += n
    got = {(r.pool, r.recipe_id, r.grp, r.product_id): r.servings for r in registry.QUERIES["sold_attribution"](spark, data_dir).collect()}
    assert got == want and sum(n > 0 for n in want.values()) > len(groups) / 2


def plain_runs(sold, payouts, back=8):
    """Payouts in order, each trying every end from the latest and every start from there back to a claimed day."""
    out = set()
    for key in {r[0] for r in payouts}:
        days = sorted((d, c) for k, d, c in sold if k == key and c)
        claimed = set()
        for _, day, want in sorted(r for r in payouts if r[0] == key):
            found = None
            for e in range(len(days) - 1, -1, -1):
                if found or not 1 <= (day - days[e][0]).days <= back:
                    continue
                total = 0
                for b in range(e, -1, -1):
                    if b in claimed:
                        break
                    total += days[b][1]
                    if total == want:
                        found = (b, e)
                        break
            if found:
                claimed |= set(range(found[0], found[1] + 1))
                out.add((key, day, want, days[found[0]][0], days[found[1]][0]))
    return out


def test_exact_runs_are_the_plain_search(spark, data_dir):
    from ledgerloom.operators import bank
    from ledgerloom.plans import bank as plans

    cents = lambda x: round(float(x) * 100)
    sold, payouts = plans._payouts(spark, data_dir)
    want = plain_runs([(r.key, r.day, cents(r.amount)) for r in sold.collect()], [(r.key, r.day, cents(r.gross)) for r in payouts.collect()])
    got = {(r.key, r.day, cents(r.gross), r.first_day, r.last_day) for r in registry.QUERIES["payout_exact_runs"](spark, data_dir).collect()}
    assert got == want and want
    r = random.Random(4)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    s = [(k, day(n), r.choice([0, 100, 200, 300, -100])) for k in "ab" for n in range(60) if r.random() < 0.8]
    p = [(k, day(n), r.choice([100, 200, 300, 400, 500])) for k in "ab" for n in range(0, 70, 2)]
    df = lambda rows, c: spark.createDataFrame([(k, d, decimal.Decimal(x) / 100) for k, d, x in rows], f"key string, day date, {c} decimal(12,2)")
    got = {(x.key, x.day, cents(x.gross), x.first_day, x.last_day) for x in bank.exact_runs(df(s, "amount"), df(p, "gross")).collect()}
    assert got == plain_runs(s, p) and len(got) > 30


def test_slips_hang_together(spark, data_dir):
    from ledgerloom.sources import views

    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in views.lines(spark, data_dir).filter("flag = 'R'").select("invoice_id", "product_id", "supplier_id").collect():
        a, b = root(r.invoice_id * 2), root((r.product_id * 7 + r.supplier_id) * 2 + 1)
        parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for x in list(parent):
        groups[root(x)].append(x)
    got = {r.root: (r.n_nodes, r.n_slips) for r in registry.QUERIES["slip_components"](spark, data_dir).collect()}
    assert got == {min(v): (len(v), sum(x % 2 == 0 for x in v)) for v in groups.values()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
