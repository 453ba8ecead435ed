"""What grows with the input is not sent through the driver, one row or one task."""

import random
from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import graph, grams, identifiers, matching, names, progress, recipes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_the_cascades_is_broadcast(spark):
    p = spark.sql("SELECT id AS payment_id, id % 7 AS key, date_add(DATE '2020-01-01', CAST(id AS INT)) AS day, CAST(25 AS DECIMAL(12,2)) AS due, id % 3 = 0 AS card FROM range(50)")
    i = spark.sql("SELECT id AS invoice_id, id % 7 AS key, date_add(DATE '2020-01-01', CAST(id AS INT)) AS invoice_day, CAST(25 AS DECIMAL(12,2)) AS total, true AS fresh FROM range(50)")
    for df in (matching.in_window(p, i), matching.latest_before(p, i), matching.subset_sums(p, i), matching.cascade(p, i)):
        assert "Broadcast" not in _plan(df)


def test_a_long_log_is_not_folded_in_one_row(spark):
    runs = spark.sql("SELECT 1 AS source, id AS run, date_add(DATE '2020-01-01', CAST(id / 500 AS INT)) AS today, true AS automatic, CAST(NULL AS DATE) AS since, date_add(DATE '2020-01-01', CAST(id / 500 AS INT)) AS until, true AS ok, DATE '2020-01-01' AS own, CAST(NULL AS DATE) AS floor FROM range(60000)")
    plan = _plan(progress.steps(runs))
    assert "collect_list" not in plan and "aggregate(" not in plan
    out = progress.steps(runs.unionByName(runs.limit(100))).groupBy().agg(F.count("*"), F.max("searched_until"), F.max("hole_from")).first()
    assert tuple(out) == (60000, date(2020, 4, 29), None)


def test_names_with_common_words_do_not_all_meet(spark):
    rows = spark.sql("SELECT id, 1 AS supplier_id, concat('HOT BOLT ECONOMY ', translate(upper(substr(md5(CAST(id AS STRING)), 1, 8)), '0123456789ABCDEF', 'GHIJKLMNOPQRSTUV'), ' 33') AS name FROM range(2000)")
    counts = grams.counted(rows.select(F.col("name").alias("s")), 4)
    keys = grams.rarest(rows.select("id", F.col("name").alias("s")), counts, 4, F.lit(9)).groupBy("gram").agg(F.count("*").alias("n"))
    assert keys.agg(F.sum(F.col("n") * F.col("n"))).first()[0] < 2000 * 2000 / 10
    # Every O read as a digit costs 0.3 of a budget of 2.
    few = rows.filter("length(name) - length(replace(name, 'O', '')) <= 6")
    assert names.misread_match(few.withColumn("name", F.regexp_replace("name", "O", "0")), rows).filter("read_id = known_id").count() == few.count()


def test_names_a_few_edits_apart_meet_by_letters_of_a_kind(spark):
    rows = spark.sql("SELECT id, concat('33 BOLT ECONOMY HOT ', translate(upper(substr(md5(CAST(id AS STRING)), 1, 8)), '0123456789ABCDEF', 'GHIJKLMNOPQRSTUV')) AS s FROM range(2000)")
    met = lambda df: df.alias("x").join(df.alias("y"), "gram").filter("x.id <> y.id")
    three = grams.letters_by_kind(rows, F.lit(3), F.lit(3))
    assert three.count() == 4 * 2000 and met(three).count() < 2000 * 2000 / 2
    # The grams that three edits may leave are words that all have.
    counts = grams.counted(rows, 3)
    assert met(grams.rarest(rows, counts, 3, F.lit(10))).count() > 2000 * 2000 / 2
    # Few of those that meet are compared letter by letter.
    assert met(three).filter(grams.differ(F.col("x.odd1"), F.col("y.odd1")) <= 3).count() < 2000 * 2000 / 50


def test_edits_leave_a_kind_of_letters_and_change_few_kinds_of_grams(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        a = "".join(r.choices("ABCDEÉ é1", k=r.choice([1, 2, 9, 30, 80])))
        b, d = list(a), r.randrange(4)
        for _ in range(d):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = "" if at < len(b) and r.randrange(2) else r.choice("ABXÉ")
        # A letter put for another is one put in and one left out.
        rows.append((i, a, "".join(b), 2 * d))
    rows = [x for x in rows if x[2]]
    frame = spark.createDataFrame(rows, "id long, a string, b string, d int").repartition(3)
    a, b = (grams.letters_by_kind(frame.select("id", "d", F.col(c).alias("s")), F.col("d"), F.col("d")).withColumnRenamed("odd1", c) for c in "ab")
    got = a.join(b, ["id", "d", "gram"]).filter(grams.differ(F.col("a"), F.col("b")) <= F.col("d"))
    assert got.select("id").distinct().count() == len(rows) > 250
    two = [grams.rarest(frame.select("id", "d", F.col(c).alias("s")), grams.counted(frame.select(F.col(c).alias("s")), 2), 2, F.lit(1), (2,)).withColumnRenamed("odd2", c).drop("gram", "s") for c in "ab"]
    assert two[0].join(two[1], ["id", "d"]).filter(grams.differ(F.col("a"), F.col("b")) > 2 * F.col("d")).count() == 0


def test_misread_costs_are_worked_out_abreast(monkeypatch):
    r = random.Random(5)
    letters, a, b = "O0QDI1LS5B8Z2G6ABC37", [], []
    for _ in range(3000):
        x = r.choices(letters, k=r.choice([0, 1, 5, 6, 14, 15, 29, 30, 47]))
        y = list(x)
        for _ in range(r.randrange(6)):
            i = r.randrange(len(y) + 1)
            like = [g for g in names.LOOK_ALIKE if i < len(y) and y[i] in g]
            y[i : i + r.randrange(2)] = r.choice(like[0]) if like and r.randrange(2) else r.choice([*letters, ""])
        a.append("".join(x))
        b.append("".join(y))
    want = [names.misread_cost(x, y, names.budget(x)) for x, y in zip(a, b, strict=True)]
    assert names.priced(a, b).tolist() == want and 900 < sum(c < 4 for c in want) < 2900
    monkeypatch.setattr(grams, "CELLS", 100)
    assert names.priced(a, b).tolist() == want and names.priced([], []).tolist() == []


def test_edges_of_a_hub_are_not_shuffled_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 50)
    edges = spark.range(1, 400).selectExpr("id AS a", "CASE WHEN id % 3 = 0 THEN id - 3 ELSE id % 3 END AS b").unionByName(spark.range(1).selectExpr("5000L AS a", "5001L AS b"))
    got = {r.node: r.root for r in graph.components(edges).collect()}
    want = {n: 0 if n % 3 == 0 else n % 3 for n in range(3, 400)} | {5001: 5000}
    assert got == want
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")).withColumnRenamed("b", "a")
    assert "BroadcastHashJoin" in _plan(graph._at_least(edges.selectExpr("b AS a", "a AS b"), least))


def test_reach_is_not_broadcast(spark):
    edges = spark.range(1, 50).selectExpr("id AS a", "id + 1 AS b")
    assert "Broadcast" not in _plan(graph.reach(edges).groupBy("a").count())
    assert graph.reach(edges).count() == 49 * 50 // 2


def test_pools_are_not_broadcast(spark):
    rows = spark.sql("SELECT id AS product_id, id AS recipe_id, 1 AS grp, 1.0D AS amount, id AS pool, 1.0D AS sold, id AS a, id AS b, 0.5D AS share FROM range(20)")
    pool_of, sold = rows.select("product_id", "pool"), rows.select("recipe_id", "sold")
    use = recipes.expected_use(rows.select("recipe_id", "grp", "product_id", "amount"), recipes.made(sold, rows.select("a", "b", "share")), pool_of)
    assert "Broadcast" not in _plan(recipes.with_own_sales(use, rows.select("product_id", F.col("amount").alias("quantity")), pool_of))


def test_equal_credits_of_a_day_look_up_anybodys_documents_once(spark):
    credits = spark.sql("SELECT id AS payment_id, date_add(DATE '2020-01-01', CAST(id % 2 AS INT)) AS day, CAST(25 AS DECIMAL(12,2)) AS due, 180 AS back, 90 AS ahead FROM range(3000)")
    days = spark.sql("SELECT CAST(25 AS DECIMAL(12,2)) AS total, date_add(DATE '2019-06-01', CAST(id AS INT)) AS invoice_day, 2 AS m, id AS invoice_id FROM range(400)")
    found = matching._anybodys(credits, days)
    assert {tuple(r) for r in found.select("day", "all", "one.*").distinct().collect()} == {(date(2020, 1, 1), 2 * 271, 0, 214), (date(2020, 1, 2), 2 * 271, 0, 215)}
    assert found.count() == 3000
    made = _rows_made(credits, days)
    assert made < 2 * 3000


def test_texts_are_read_for_identifiers_once(spark, data_dir):
    from ledgerloom.plans import parties

    plan = _plan(parties.supplier_identifiers(spark, data_dir))
    assert "regexp_extract_all" not in plan and "lineitem" not in plan
    known = spark.createDataFrame([(1, "tel:1"), (2, "tel:2"), (1, "tel:shared"), (2, "tel:shared")], "supplier_id long, identifier string")
    printed = spark.createDataFrame([(1, "tel:1"), (1, "tel:shared"), (1, "web:x.fr"), (2, "tel:2"), (2, "siren:9"), (3, "tel:shared")], "doc_id long, identifier string")
    assert [tuple(r) for r in identifiers.recognised(printed, known).collect()] == [(1, 1, "tel:1")]


def test_guards_lose_no_identifier(spark):
    from ledgerloom.functions import text

    texts = ["HTTPS://WWW.A-B.COM", "see WWW.Shop.Fr", "(http://Xy.Org/)", "abc.EU", "+33 1 23 45 67 89", "0123456789", "fr44732829320", "FR44732829320"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.identifiers(F.col("t")).alias("x")).collect()]
    assert got == [["web:a-b.com"], ["web:shop.fr"], ["web:xy.org"], ["web:abc.eu"], ["tel:0123456789"], ["tel:0123456789"], [], ["siren:732829320"]]


def _rows_made(credits, days):
    """Rows of the widest join of the lookup."""
    found = matching._anybodys(credits, days)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    nodes, most = [plan], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most
