"""Nothing lost, nothing twice: operators against plain loops over all pairs, paths, batches and letters."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text
from ledgerloom.operators import graph, invoices, names, upkeep
from ledgerloom.plans import registry
from ledgerloom.streaming import till


def plain_cost(a, b):
    """The table of weighted edits, filled whole."""
    of = {c: g for g in names.LOOK_ALIKE for c in g}
    inf = float("inf")
    edit = lambda *x: inf if any(c.isdigit() for c in x) else 1.0
    t = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                t[i, j] = min(
                    t[i - 1, j] + edit(a[i - 1]) if i else inf, t[i, j - 1] + edit(b[j - 1]) if j else inf,
                    t[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 0.3 if b[j - 1] in of.get(a[i - 1], "") else edit(a[i - 1], b[j - 1])) if i and j else inf,
                )
    return t[len(a), len(b)]


def plain_match(read, known):
    fold = lambda s: "".join(c for c in s.upper() if c.isascii() and c.isalnum())
    out = set()
    for i, s, x in read:
        a = fold(x)
        most = 0.9 if len(a) < 6 else 1 + len(a) // 15
        costs = sorted((c, k) for k, t, y in known if t == s and (c := plain_cost(a, fold(y))) <= most)
        if costs and (len(costs) == 1 or costs[1][0] - costs[0][0] >= 0.5):
            out.add((i, costs[0][1], round(costs[0][0], 6)))
    return out


def test_misread_match_finds_all(spark):
    r = random.Random(3)
    letters = "ABEGILOQSTZ0158DKNR"
    known = [(i, "s%d" % (i % 2), "".join(r.choice(letters) for _ in range(n))) for i, n in enumerate([*[3, 4, 5, 6, 7, 9, 12, 13, 14, 15, 16, 18, 22, 29, 30, 31, 37, 45, 46] * 3, 1, 2, 5])]
    known += [(900, "s0", "RED BOLT BIG GREEN NUT"), (901, "s1", "GEAR")]
    read = [(5000, "s0", "RED BOXT BIG GREEN NUX"), (5001, "s1", ""), (5002, "s0", "BED BOIT 8IG GREEN NUT")]
    for i, s, x in known:
        for j in range(4):
            y = list(x)
            for _ in range(r.randrange(0, 5)):
                at = r.randrange(len(y) + 1)
                what = r.randrange(4)
                if what == 0:
                    y.insert(at, r.choice(letters))
                elif y and at < len(y):
                    if what == 1:
                        del y[at]
                    elif what == 2:
                        y[at] = r.choice(letters)
                    else:
                        y[at] = r.choice({c: g for g in names.LOOK_ALIKE for c in g}.get(y[at], y[at]))
            read.append((len(read) + 10_000, s, "".join(y)))
    df = lambda rows: spark.createDataFrame(rows, "id long, supplier_id string, name string")
    got = {(x.read_id, x.known_id, round(x.cost, 6)) for x in names.misread_match(df(read), df(known)).collect()}
    want = plain_match(read, known)
    assert got == want and (5000, 900, 2.0) in got and len(want) > 60


def test_ocr_match_is_the_loop_over_all_pairs(spark, data_dir):
    part = spark.read.parquet(f"{data_dir}/part.parquet").select("p_partkey", "p_type", "p_name").collect()
    known = defaultdict(lambda: 1 << 60)
    for p in part:
        known[p.p_type, p.p_name.upper()] = min(known[p.p_type, p.p_name.upper()], p.p_partkey)
    read = [(p.p_partkey, p.p_type, p.p_name.upper().translate(str.maketrans("OIS", "015")) if p.p_partkey % 2 == 0 else p.p_name.upper().replace("E", "F")) for p in part]
    got = {(x.read_id, x.known_id, round(x.cost, 6)) for x in registry.QUERIES["ocr_match"](spark, data_dir).collect()}
    assert got == plain_match(read, [(i, t, n) for (t, n), i in known.items()]) and got


@pytest.mark.parametrize("keyed", [True, False])
def test_many_batches_count_once(spark, data_dir, tmp_path, keyed):
    rows = spark.read.parquet(f"{data_dir}/events.parquet").orderBy("ts").limit(800)
    cut = rows.withColumn("part", F.ntile(4).over(Window.orderBy("ts", "event_id"))).cache()
    for i in range(1, 5):
        cut.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = till.event_stream(spark, str(tmp_path), 1, "*.parquet", f"{data_dir}/events.parquet")
    if not keyed:
        assert till.drained(stream).count() == 800
        return
    got = {(r.day, r.event_type): (r.n, r.total) for r in till.drained(till.business_days(stream), ["day", "event_type"]).collect()}
    day = F.to_date(F.col("ts") - F.expr("interval 6 hours"))
    want = {(r.day, r.event_type): (r.n, r.total) for r in rows.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total")).collect()}
    assert got == want


def test_search_key_folds_every_accent(spark):
    rows = [("été",), ("été",), ("Őž Łódź",), ("ÀÉÎÕÜ ǅ Ṩ",), ("Straße",), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(text.search_key(F.col("t")).alias("k")).collect()]
    assert got == ["ete", "ete", "oz łodz", "aeiou ǆ s", "straße", None]


def test_shares_below_ends_circles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (5, 7), (6, 8), (7, 8), (9, 9)]
    got = {(r.a, r.b): r.share for r in upkeep.shares_below(spark.createDataFrame(edges, "a long, b long"), 0.5).collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.25, (2, 3): 0.5, (2, 1): 0.25, (3, 1): 0.5, (3, 2): 0.25, (4, 1): 0.5, (4, 2): 0.25, (4, 3): 0.125, (5, 6): 0.5, (5, 7): 0.5, (6, 8): 0.5, (7, 8): 0.5, (5, 8): 0.5}


def test_final_versions_on_rings(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 4), (6, 6), (7, 8), (8, None), (9, 1), (10, 99), (11, 10), (12, 13), (13, 14), (14, 15), (15, 12), (16, 9)]
    got = {r.id: r.final_id for r in invoices.final_versions(spark.createDataFrame(rows, "id long, replaced_by long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 8, 8: 8, 9: 1, 10: 99, 11: 99, 12: 12, 13: 12, 14: 12, 15: 12, 16: 1}
    assert invoices.final_versions(spark.createDataFrame([], "id long, replaced_by long")).count() == 0


def test_all_variations(spark):
    rows = [(1, g, list(range(g * 10, g * 10 + n))) for g, n in enumerate((5, 4, 3, 2))] + [(2, 0, [7])]
    got = invoices.variation_at(spark.createDataFrame(rows, "recipe_id long, grp int, options array<long>")).collect()
    assert len(got) == 121 and len({(r.recipe_id, tuple(r.products)) for r in got}) == 121


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}
