"""Queries over daily series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import series
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query

D = "double"


def _today():
    return F.lit(date(2000, 6, 30))


@query("""
WITH d AS (SELECT product_id, day, CAST(sum(quantity) AS DOUBLE) AS q FROM lines WHERE flag <> 'R' AND day <= DATE '2000-06-30' GROUP BY 1, 2),
p AS (SELECT product_id, sum(q * pow(0.5, (DATE '2000-06-30' - day) / 90.0)) AS w, max(DATE '2000-06-30' - day) AS o FROM d GROUP BY 1)
SELECT product_id, round(w / ((1 - pow(pow(0.5, 1 / 90.0), o + 1)) / (1 - pow(0.5, 1 / 90.0))), 6) AS rate FROM p
""")
def decayed_rate(spark, sf_dir):
    rows = views.lines(spark, sf_dir).filter("flag <> 'R' and day <= date'2000-06-30'")
    return series.decayed_rate(rows, "product_id", _today()).withColumn("rate", F.round("rate", 6))


@query("""
WITH p AS (SELECT DISTINCT product_id, day FROM lines WHERE flag = 'A'), s AS (SELECT product_id, day AS start, lead(day, 1, DATE '2010-01-01') OVER (PARTITION BY product_id ORDER BY day) AS "end" FROM p), q AS (SELECT product_id, day, sum(quantity) AS q FROM lines WHERE flag = 'N' GROUP BY 1, 2)
SELECT s.product_id, s.start, CAST(coalesce(sum(q), 0) AS DOUBLE) AS consumed FROM s LEFT JOIN q ON q.product_id = s.product_id AND q.day >= s.start AND q.day < s."end" GROUP BY 1, 2
""")
def consumed_between_purchases(spark, sf_dir):
    rows = views.lines(spark, sf_dir)
    w = Window.partitionBy("product_id").orderBy("day")
    bought = rows.filter("flag = 'A'").select("product_id", "day").distinct()
    spans = bought.select("product_id", F.row_number().over(w).cast("long").alias("id"), F.col("day").alias("start"), F.coalesce(F.lead("day").over(w), F.lit(date(2010, 1, 1))).alias("end"))
    out = series.sums_between(rows.filter("flag = 'N'"), spans, "product_id")
    return out.select("product_id", "start", F.col("total").cast(D).alias("consumed"))


@query("""
WITH a AS (SELECT method, day, amount FROM till_payments WHERE day < DATE '2024-01-25'), b AS (SELECT method, day, round(amount * 0.98, 2) AS amount FROM till_payments WHERE day >= DATE '2024-01-04'),
c AS (SELECT method, greatest((SELECT min(day) FROM a x WHERE x.method = m.method), (SELECT min(day) FROM b x WHERE x.method = m.method)) AS lo, least((SELECT max(day) FROM a x WHERE x.method = m.method), (SELECT max(day) FROM b x WHERE x.method = m.method)) AS hi FROM (SELECT DISTINCT method FROM a) m),
x AS (SELECT method, sum(CASE WHEN day BETWEEN lo AND hi THEN amount ELSE 0 END) AS a, sum(CASE WHEN day BETWEEN lo AND hi THEN 0 ELSE amount END) AS ao FROM a JOIN c USING (method) GROUP BY 1), y AS (SELECT method, sum(CASE WHEN day BETWEEN lo AND hi THEN amount ELSE 0 END) AS b, sum(CASE WHEN day BETWEEN lo AND hi THEN 0 ELSE amount END) AS bo FROM b JOIN c USING (method) GROUP BY 1)
SELECT method, CAST(a AS DOUBLE) AS till, CAST(b AS DOUBLE) AS bank, CAST(a - b AS DOUBLE) AS difference, CAST(ao AS DOUBLE) AS till_outside, CAST(bo AS DOUBLE) AS bank_outside FROM x JOIN y USING (method)
""")
def method_comparison(spark, sf_dir):
    """The till against the bank by method, over the days that both cover."""
    rows = views.till_payments(spark, sf_dir)
    out = series.compared(rows.filter("day < date'2024-01-25'"), rows.filter("day >= date'2024-01-04'").withColumn("amount", F.round(F.col("amount") * F.lit("0.98").cast("decimal(4,2)"), 2)), "method")
    return out.select("method", *(F.col(a).cast(D).alias(b) for a, b in (("a", "till"), ("b", "bank"), ("difference", "difference"), ("a_outside", "till_outside"), ("b_outside", "bank_outside"))))


@query("""
WITH p AS (SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY line, product_id, supplier_id, day, ht) AS pos, CAST(ceil(ht / 20000) AS BIGINT) AS v FROM lines), r AS (SELECT *, sum(v) OVER (PARTITION BY invoice_id ORDER BY pos) AS hi, 5 + invoice_id % 4 AS target FROM p),
m AS (SELECT a.invoice_id, a.pos AS first, b.pos AS last, row_number() OVER (PARTITION BY a.invoice_id ORDER BY b.pos - a.pos DESC, a.pos) AS r FROM r a JOIN r b ON a.invoice_id = b.invoice_id AND b.pos >= a.pos AND b.hi - (a.hi - a.v) = a.target)
SELECT invoice_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM m WHERE r = 1
""")
def charge_runs(spark, sf_dir):
    """The longest run of an invoice's lines that adds up to a total printed on it."""
    w = Window.partitionBy("invoice_id").orderBy("line", "product_id", "supplier_id", "day", "ht")
    rows = views.lines(spark, sf_dir).select("invoice_id", F.row_number().over(w).alias("pos"), F.ceil(F.col("ht") / 20000).cast("long").alias("v")).withColumn("target", 5 + F.col("invoice_id") % 4)
    return series.longest_run_to(rows, "invoice_id", "pos", "v")


@query("""
WITH l AS (SELECT supplier_id, product_id, quantity, day, dense_rank() OVER (PARTITION BY supplier_id ORDER BY day DESC) AS r FROM lines WHERE flag <> 'R'), p AS (SELECT supplier_id, product_id, sum(quantity) AS q, max(day) AS d FROM l WHERE r <= 5 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY q DESC, d DESC, product_id) AS n FROM p) SELECT supplier_id, product_id, CAST(q AS DOUBLE) AS quantity FROM k WHERE n = 1
""")
def usual_product(spark, sf_dir):
    return series.usual_product(views.lines(spark, sf_dir).filter("flag <> 'R'"), "supplier_id")


@query("""
WITH d AS (SELECT DISTINCT product_id, supplier_id, day FROM lines WHERE flag <> 'R'), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day DESC, supplier_id) AS r FROM d), l AS (SELECT product_id, list(supplier_id) AS last FROM r WHERE r <= 3 GROUP BY 1 HAVING count(*) = 3)
SELECT d.product_id, d.supplier_id, count(*) AS n_days, NOT list_contains(any_value(last), d.supplier_id) AS bought_elsewhere FROM d JOIN l USING (product_id) GROUP BY 1, 2
""")
def store_switch(spark, sf_dir):
    """Products whose last three purchases were all at other stores."""
    d = views.lines(spark, sf_dir).filter("flag <> 'R'").select("product_id", "supplier_id", "day").distinct()
    last = d.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("day"), "supplier_id"))).filter("r <= 3").groupBy("product_id").agg(F.collect_list("supplier_id").alias("last")).filter("size(last) = 3")
    n = d.groupBy("product_id", "supplier_id").agg(F.count("*").alias("n_days"))
    return n.join(last, "product_id").select("product_id", "supplier_id", "n_days", (~F.array_contains("last", F.col("supplier_id"))).alias("bought_elsewhere"))


@query("""
SELECT p_partkey AS product_id, max(l.day) FILTER (WHERE flag <> 'R') AS last_sale, count(l.day) AS n_lines FROM part LEFT JOIN lines l ON l.product_id = p_partkey GROUP BY 1
""")
def last_sale_day(spark, sf_dir):
    """The last day that each product sold, returns aside; products that never did have none."""
    per = views.lines(spark, sf_dir).groupBy("product_id").agg(F.max(F.when(F.col("flag") != "R", F.col("day"))).alias("last_sale"), F.count("*").alias("n_lines"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id")).join(per, "product_id", "left").select("product_id", "last_sale", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


@query("""
WITH e AS (SELECT supplier_id, product_id, category, ht FROM lines JOIN products USING (product_id) WHERE category <> 'C3' AND supplier_id % 17 <> 0 AND NOT (supplier_id % 10 = 1 AND product_id % 5 = 0)) SELECT category, count(*) AS n_lines, CAST(sum(ht) AS DOUBLE) AS ht FROM e GROUP BY 1
""")
def exclusions(spark, sf_dir):
    """Totals without what was left out: a category, some stores, some pairs of store and product, each an anti-join."""
    rows = views.lines(spark, sf_dir).join(views.products(spark, sf_dir).select("product_id", "category"), "product_id")
    stores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id")).filter("supplier_id % 17 = 0")
    pairs = rows.filter("supplier_id % 10 = 1 and product_id % 5 = 0").select("supplier_id", "product_id").distinct()
    kept = rows.filter("category <> 'C3'").join(stores, "supplier_id", "left_anti").join(pairs, ["supplier_id", "product_id"], "left_anti")
    return kept.groupBy("category").agg(F.count("*").alias("n_lines"), F.sum("ht").cast(D).alias("ht"))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (WHERE ts < now - INTERVAL 3 DAY) AS late, count(*) FILTER (WHERE ts >= now - INTERVAL 3 DAY) AS on_time, max(CAST(ts AS DATE)) AS last_day FROM events, m GROUP BY 1
""")
def late_lines(spark, sf_dir):
    """What a reader that goes three days back would still take, and what is left for a catch-up."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts")
    now = rows.agg(F.max("ts").alias("now"))
    late = F.col("ts") < F.col("now") - F.expr("interval 3 day")
    return rows.join(F.broadcast(now)).groupBy("event_type").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("on_time"), F.max(F.to_date("ts")).alias("last_day"))
