"""Scalar columns and operators on small tables."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, text, windows
from ledgerloom.operators import bank, graph, matching, recipes, spreads, stock


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in zip(names, [_kind(v) for v in values.values()], strict=True))).select(column.alias("x")).first().x


def _kind(v):
    return {str: "string", Decimal: "decimal(12,4)", date: "date", datetime: "timestamp_ntz", int: "int", type(None): "string"}[type(v)]


def test_money(spark):
    d = Decimal
    assert one(spark, money.cents(F.col("a")), a=d("-2.345")) == d("-2.35")
    assert one(spark, money.truncated(F.col("a")), a=d("-2.349")) == d("-2.34")
    assert one(spark, money.vat_divisor(F.col("a").cast("decimal(5,4)")), a=d("-1")) == 1
    assert one(spark, money.percent(F.col("a"), F.lit(0)), a=d("3")) is None
    assert one(spark, money.held(F.col("a"), F.lit(-5)), a=d("3")) == 0 and one(spark, money.held(F.col("a"), F.lit(-5)), a=d("-7")) == -5
    assert one(spark, money.loss_allowance(F.col("a"), F.lit(150)), a=d("8")) == 8 and one(spark, money.loss_allowance(F.col("a"), F.lit(10)), a=d("-8")) == 0
    assert one(spark, money.number(F.col("a")), a="1 234,50") == d("1234.5") and one(spark, money.number(F.col("a")), a="12 34") is None and one(spark, money.number(F.col("a")), a="abc") is None
    assert one(spark, money.vat_rate(F.col("a")), a="5,5 %") == d("0.055") and one(spark, money.vat_rate(F.col("a")), a="0.2") == d("0.2") and one(spark, money.vat_rate(F.col("a")), a="20") == d("0.2")
    assert one(spark, money.fits(F.col("a"), 4, 2), a=d("99.99")) and not one(spark, money.fits(F.col("a"), 4, 2), a=d("100")) and not one(spark, money.fits(F.col("a"), 4, 2), a=d("1.234"))
    assert one(spark, money.line_ttc(F.lit(None).cast("decimal(12,2)"), F.lit(None).cast("decimal(12,2)"), F.col("a"), F.lit(Decimal("0.2"))), a=d("10")) == 12


def test_windows(spark):
    a, b = date(2024, 1, 1), date(2024, 2, 1)
    df = spark.createDataFrame([(a,), (b,), (date(2024, 3, 1),), (None,)], "d date")
    assert df.filter(windows.closed(F.col("d"), b, a)).count() == 2 and df.filter(windows.closed(F.col("d"))).count() == 4
    assert [r.d for r in df.filter(windows.between_counts(F.col("d"), a, b)).collect()] == [b]
    assert one(spark, windows.business_day(F.col("t")), t=datetime(2024, 5, 2, 5, 59)) == date(2024, 5, 1)
    for year, day in ((2024, date(2024, 3, 31)), (2025, date(2025, 4, 20)), (1999, date(1999, 4, 4)), (2038, date(2038, 4, 25))):
        assert one(spark, windows.easter(F.col("y")), y=year) == day
    assert len(one(spark, windows.holidays(F.col("y")), y=2024)) == 11
    assert windows.last_twelve_months(date(2025, 3, 1)) == (date(2024, 3, 1), date(2025, 3, 1))


def test_instants(spark):
    df = spark.createDataFrame([(date(2024, 3, 29), date(2024, 4, 2))], "a date, b date")
    got = df.select(windows.instants(F.col("a"), F.col("b"), [4, 0], ["09:00", "22:30"]).alias("x")).select(F.transform("x", lambda t: t.cast("string")).alias("x")).first().x
    assert got == ["2024-03-29 08:00:00", "2024-03-29 21:30:00", "2024-04-01 07:00:00", "2024-04-01 20:30:00"]


def test_text(spark):
    assert one(spark, text.search_key(F.col("a")), a="Été ÇA") == "ete ca"
    assert one(spark, text.ocr_fold(F.col("a")), a="Réf. 12-b") == "REF12B"
    assert one(spark, text.numeric_signature(F.col("a")), a="vin 07,5 x 06 (2019)") == ["2019", "6", "7.5"]
    assert one(spark, text.luhn_candidates(F.col("a")), a="732829320 and 732829321, 7328293200") == ["732829320"]
    assert one(spark, text.vat_key(F.col("a")), a="732829320") == "44"
    assert one(spark, text.size_of(F.col("a")), a="biere 6x33cl").asDict() == {"quantity": Decimal("0.3300"), "unit": "l", "times": 6}
    assert one(spark, text.size_of(F.col("a")), a="gants") is None


def test_spread_adds_back(spark):
    rows = spark.createDataFrame([(1, 1, Decimal("-10.00"), Decimal("1")), (1, 2, Decimal("-10.00"), Decimal("1")), (1, 3, Decimal("-10.00"), Decimal("1")), (2, 1, Decimal("5.00"), Decimal("0")), (2, 2, Decimal("5.00"), Decimal("-3"))], "d int, p int, a decimal(12,2), w decimal(12,2)")
    got = {(r.d, r.p): r.share for r in spreads.largest_remainder(rows, "d", "p", "a", "w").collect()}
    assert [got[1, i] for i in (1, 2, 3)] == [Decimal("-3.34"), Decimal("-3.33"), Decimal("-3.33")] and got[2, 1] == got[2, 2] == 0
    parts = spark.createDataFrame([(1, "a", Decimal("1.0050")), (1, "b", Decimal("1.0050")), (1, "c", Decimal("-2.0000"))], "g int, p string, x decimal(12,4)")
    got = {r.p: r.rounded for r in spreads.rounded_with_rest(parts, "g", "p", "x").collect()}
    assert sum(got.values()) == Decimal("0.01") and got["a"] == Decimal("1.01")


def test_fifo(spark):
    ladder = spark.createDataFrame([("a", date(2024, 1, 1), 1, Decimal("10"), Decimal("10")), ("a", date(2024, 2, 1), 2, Decimal("5"), Decimal("10")), ("a", None, 3, Decimal("2"), Decimal("8")), ("a", date(2024, 3, 1), 4, Decimal("-9"), Decimal("9"))], "k string, day date, tie int, quantity decimal(12,3), cost decimal(12,2)")
    counts = spark.createDataFrame([("a", Decimal("20")), ("b", Decimal("3"))], "k string, counted decimal(12,3)")
    got = {r.k: r for r in stock.fifo_valuation(ladder, counts, "k").collect()}
    assert got["a"].value_ht == pytest.approx(10 + 10 + 8 + 3 * 4) and got["a"].shortfall == 3 and got["b"].value_ht == 0 and got["b"].shortfall == 3


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (5, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert {(r.a, r.b) for r in graph.reach(loop).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)}


def test_waterfall(spark):
    c = spark.createDataFrame([("k", 1, date(2024, 1, 1), 10), ("k", 2, date(2024, 1, 2), 7)], "key string, id long, day date, amount int")
    d = spark.createDataFrame([("k", 8, date(2024, 1, 1), 4), ("k", 9, date(2024, 1, 3), 9), ("k", 10, date(2024, 1, 4), 9)], "key string, id long, day date, due int")
    assert sorted((r.credit_id, r.doc_id, r.share) for r in bank.waterfall(c, d).collect()) == [(1, 8, 4), (1, 9, 6), (2, 9, 3), (2, 10, 4)]


def test_exact_runs(spark):
    sold = spark.createDataFrame([("k", date(2024, 1, i), Decimal(i)) for i in range(1, 10)], "key string, day date, amount decimal(22,2)")
    paid = spark.createDataFrame([("k", date(2024, 1, 5), Decimal("7")), ("k", date(2024, 1, 7), Decimal("11")), ("k", date(2024, 1, 8), Decimal("7"))], "key string, day date, gross decimal(22,2)")
    got = [(r.day.day, r.first_day.day, r.last_day.day) for r in bank.exact_runs(sold, paid).orderBy("day").collect()]
    assert got == [(5, 3, 4), (7, 5, 6), (8, 7, 7)]


def test_attribution_is_dearest_first(spark):
    rows = spark.createDataFrame([(1, 10, 1, 100, 1.0, 10.0, 6.0, 0.5, 5.0), (1, 10, 1, 101, 1.0, 10.0, 3.0, 0.0, 2.0)], "pool long, recipe_id long, grp int, product_id long, amount double, sold double, available double, loss double, cost double")
    got = {r.product_id: r.servings for r in recipes.attribute_choices(rows).collect()}
    # 3 of the dear one within its loss, 3 of the other, 3 more of the dear one, the last to the dear one.
    assert got == {100: 7, 101: 3}


def test_attribution_takes_certain_use_first(spark):
    # Recipe 11 takes 4 of product 100 for certain and 2 went elsewhere: of 10, 4 servings of the choice are left.
    rows = [(1, 10, 1, 100, 1.0, 6.0, 10.0, 0.0, 5.0, 2.0), (1, 10, 1, 101, 1.0, 6.0, 9.0, 0.0, 2.0, 0.0), (1, 11, 1, 100, 1.0, 4.0, 10.0, 0.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "pool long, recipe_id long, grp int, product_id long, amount double, sold double, available double, loss double, cost double, used double")
    assert {(r.recipe_id, r.product_id): r.servings for r in recipes.attribute_choices(df).collect()} == {(10, 100): 4, (10, 101): 2, (11, 100): 4}


def test_sub_recipes(spark):
    from ledgerloom.operators.upkeep import shares_below

    below = shares_below(spark.createDataFrame([(30, 20), (20, 10)], "a long, b long"), 0.5)
    items = [(10, 1, 1, 2.0), (10, 1, 2, 4.0), (10, 2, 9, 4.0), (20, 1, 3, 1.0), (30, 1, 4, 8.0), (30, 1, 5, 0.0)]
    ingredients = spark.createDataFrame(items, "recipe_id long, grp int, product_id long, amount double")
    costs = spark.createDataFrame([(i, 1.0) for i in (1, 2, 3, 4, 5, 9)], "product_id long, unit_cost double")
    got = {r.recipe_id: (r.low, r.high, r.low_positive, int(r.n_variations)) for r in recipes.cost_bounds(ingredients, costs, below).collect()}
    assert got == {10: (6.0, 8.0, 6.0, 2), 20: (4.0, 5.0, 4.0, 2), 30: (2.0, 10.5, 2.0, 4)}
    pool_of = recipes.pools(ingredients, below)
    assert {r.product_id: r.pool for r in pool_of.collect()} == {1: 1, 2: 1, 9: 1, 3: 1, 4: 4, 5: 4}
    sold = recipes.made(spark.createDataFrame([(30, 4), (10, 1)], "recipe_id long, sold long"), below)
    assert {r.recipe_id: r.sold for r in sold.collect()} == {30: 4.0, 20: 2.0, 10: 2.0}
    assert {r.pool: (r.expected_min, r.expected_max) for r in recipes.expected_use(ingredients, sold, pool_of).collect()} == {1: (14.0, 18.0), 4: (0.0, 32.0)}
    assert {r.product_id: r.used for r in recipes.fixed_use(ingredients, sold).collect()} == {9: 8.0, 3: 2.0}


def test_merged_intervals(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 3, 4), ("k", 5, 9), ("k", 11, 12)], "k string, a int, b int")
    assert sorted((r.a, r.b, r.n) for r in matching.merged_intervals(rows, "k", "a", "b").collect()) == [(1, 9, 3), (11, 12, 1)]
