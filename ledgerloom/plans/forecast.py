"""Queries over the rhythm of purchases. Today is a day inside the ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import forecast, series
from ledgerloom.sources import views

from .registry import query

def _today():
    return F.lit(date(2000, 6, 30))


BOUGHT = "bought AS (SELECT supplier_id AS store, article, day, quantity FROM lines JOIN products USING (product_id) WHERE flag <> 'R' AND day <= DATE '2000-06-30')"


def _bought(spark, sf_dir):
    rows = views.lines(spark, sf_dir).filter("flag <> 'R' and day <= date'2000-06-30'")
    return rows.join(views.products(spark, sf_dir).select("product_id", "article"), "product_id").select(F.col("supplier_id").alias("store"), "article", "day", "quantity")


@query("""
WITH d AS (SELECT DISTINCT supplier_id, day FROM lines), g AS (SELECT supplier_id, day, day - lag(day) OVER (PARTITION BY supplier_id ORDER BY day) AS gap, row_number() OVER (PARTITION BY supplier_id ORDER BY day DESC) AS r FROM d)
SELECT supplier_id, median(gap) AS usual_gap, count(*) AS n_gaps FROM g WHERE r <= 30 AND gap IS NOT NULL GROUP BY 1
""")
def store_visit_gaps(spark, sf_dir):
    return forecast.last_gaps(views.lines(spark, sf_dir), "supplier_id", "day")


@query("""
WITH p AS (SELECT product_id, day, sum(quantity) AS q FROM lines WHERE flag <> 'R' AND day <= DATE '2000-06-30' GROUP BY 1, 2),
g AS (SELECT *, CAST(day - lag(day) OVER (PARTITION BY product_id ORDER BY day) AS DOUBLE) AS gap, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS r FROM p),
s AS (SELECT product_id, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day, median(gap) AS median_gap, stddev_pop(gap) / nullif(avg(gap), 0) AS variation, median(CASE WHEN r <= 3 THEN CAST(q AS DOUBLE) END) AS usual_quantity FROM g GROUP BY 1)
SELECT product_id, n_days, first_day, last_day, median_gap, round(variation, 6) AS variation, usual_quantity, CASE WHEN n_days = 1 THEN 'one_off' WHEN DATE '2000-06-30' - last_day > greatest(3 * coalesce(median_gap, 0), 60) THEN 'dropped' WHEN n_days < 3 THEN 'new' WHEN variation <= 0.5 THEN 'regular' ELSE 'irregular' END AS state FROM s
""")
def article_rhythm(spark, sf_dir):
    rows = forecast.rhythm(views.lines(spark, sf_dir).filter("flag <> 'R' and day <= date'2000-06-30'"), "product_id")
    return rows.withColumn("state", forecast.state(rows, _today())).withColumn("variation", F.round("variation", 6))


@query(f"""
WITH {BOUGHT}, s AS (SELECT article, CAST(sum(CASE WHEN DATE '2000-06-30' - day BETWEEN 0 AND 89 THEN quantity ELSE 0 END) AS DOUBLE) AS recent, CAST(sum(CASE WHEN DATE '2000-06-30' - day BETWEEN 90 AND 364 THEN quantity ELSE 0 END) AS DOUBLE) AS before FROM bought GROUP BY 1),
r AS (SELECT *, (recent / 90) / nullif(before / 275, 0) AS ratio FROM s)
SELECT article, recent, before, ratio, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio >= 1.5 THEN 'up' WHEN ratio <= 0.5 THEN 'down' ELSE 'flat' END AS trend FROM r
""")
def trend(spark, sf_dir):
    return forecast.trend(_bought(spark, sf_dir), "article", _today())


CHANCE = f"""
{BOUGHT}, days AS (SELECT store, article, day, sum(quantity) AS q FROM bought GROUP BY 1, 2, 3), visits AS (SELECT DISTINCT store, day, pow(0.5, (DATE '2000-06-30' - day) / 180.0) AS w FROM bought),
first AS (SELECT article, min(day) AS first_day FROM days GROUP BY 1), here AS (SELECT store, article, sum(pow(0.5, (DATE '2000-06-30' - day) / 180.0)) AS here, count(*) AS n_days FROM days GROUP BY 1, 2),
h AS (SELECT store, article, any_value(n_days) AS n_days, (any_value(here) + 0.1) / (coalesce(sum(w), 0) + 1) AS habit FROM here JOIN first USING (article) LEFT JOIN visits USING (store) WHERE day >= first_day GROUP BY 1, 2),
ever AS (SELECT article, max(day) AS last_day, CAST(sum(CAST(q AS DOUBLE) * pow(0.5, (DATE '2000-06-30' - day) / 90.0)) AS DOUBLE) / ((1 - pow(pow(0.5, 1 / 90.0), DATE '2000-06-30' - min(day) + 1)) / (1 - pow(0.5, 1 / 90.0))) AS rate FROM days GROUP BY 1), lastq AS (SELECT article, CAST(sum(q) AS DOUBLE) AS last_q FROM days JOIN ever USING (article) WHERE day = last_day GROUP BY 1),
c AS (SELECT store, article, n_days, habit, least(greatest((DATE '2000-06-30' - last_day + 7) / (last_q / rate), 0.1), 2.0) AS need, least(greatest(habit, 1e-4), 1 - 1e-4) AS p FROM h JOIN ever USING (article) JOIN lastq USING (article)),
z AS (SELECT *, 1 / (1 + exp(-(ln(p / (1 - p)) + 0.39 + 0.82 * ln(need) - CASE WHEN n_days < 3 THEN 2.0 ELSE 0 END))) AS chance FROM c)
"""


def _chances(spark, sf_dir):
    """Chance that a store's next visit, a week on, buys each article: habit there, need by the calendar at the decayed rate."""
    bought = _bought(spark, sf_dir)
    days = bought.groupBy("store", "article", "day").agg(F.sum("quantity").alias("q"))
    per_day = days.groupBy("article", "day").agg(F.sum("q").cast("double").alias("q"))
    rate = series.decayed_rate(per_day.withColumnRenamed("q", "quantity"), "article", _today())
    ever = per_day.groupBy("article").agg(F.max("day").alias("last_day"), F.max_by("q", "day").alias("last_q")).join(rate, "article")
    rows = forecast.habit(days, bought, _today()).join(ever, "article")
    need = forecast.calendar_need(F.col("last_day"), F.col("last_q"), F.col("rate"), _today(), 7)
    need = F.least(F.greatest(need, F.lit(forecast.NEED_LOW)), F.lit(forecast.NEED_HIGH))
    rows = rows.withColumn("need", need)
    return rows.withColumn("chance", forecast.chance(F.col("habit"), F.col("need"), F.col("n_days") < forecast.FEW))


@query(f"WITH {CHANCE} SELECT store, article, n_days, round(habit, 6) AS habit, round(need, 6) AS need, round(chance, 6) AS chance FROM z")
def chance(spark, sf_dir):
    return _chances(spark, sf_dir).select("store", "article", "n_days", *(F.round(c, 6).alias(c) for c in ("habit", "need", "chance")))


@query(f"""
WITH {CHANCE}, s AS (SELECT store, article, round(chance, 6) AS chance, CASE WHEN chance >= 0.25 THEN 'buy' WHEN chance >= 0.125 THEN 'maybe' ELSE 'quiet' END AS section FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY store, section ORDER BY chance DESC, article) AS place FROM s) SELECT store, section, article, chance, place FROM r WHERE place <= 10
""")
def store_plan(spark, sf_dir):
    """A store's list: sections by chance, the ten likeliest articles of each (a top-k report)."""
    c = F.col("chance")
    rows = _chances(spark, sf_dir).withColumn("section", F.when(c >= forecast.BUY_AT, "buy").when(c >= forecast.MAYBE_AT, "maybe").otherwise("quiet")).withColumn("chance", F.round(c, 6))
    place = F.row_number().over(Window.partitionBy("store", "section").orderBy(F.desc("chance"), "article"))
    return rows.select("store", "section", "article", "chance", place.cast("long").alias("place")).filter("place <= 10")


@query("""
WITH d AS (SELECT DISTINCT supplier_id AS store, category, day FROM lines JOIN products USING (product_id)), v AS (SELECT DISTINCT store, day FROM d), last AS (SELECT store, day, row_number() OVER (PARTITION BY store ORDER BY day DESC) AS r FROM v),
k AS (SELECT store, min(day) AS since FROM last WHERE r <= 3 GROUP BY 1), b AS (SELECT store, category, max(day) AS last_bought, count(*) AS n_days FROM d GROUP BY 1, 2)
SELECT store, category, n_days, last_bought, last_bought < since AS missed_thrice FROM b JOIN k USING (store)
""")
def nag_replay(spark, sf_dir):
    """What was not bought at any of a store's last three visits."""
    rows = views.lines(spark, sf_dir).join(views.products(spark, sf_dir).select("product_id", "category"), "product_id").select(F.col("supplier_id").alias("store"), "category", "day").distinct()
    visits = rows.select("store", "day").distinct()
    since = visits.withColumn("r", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("day")))).filter("r <= 3").groupBy("store").agg(F.min("day").alias("since"))
    per = rows.groupBy("store", "category").agg(F.max("day").alias("last_bought"), F.count("*").alias("n_days"))
    return per.join(since, "store").select("store", "category", "n_days", "last_bought", (F.col("last_bought") < F.col("since")).alias("missed_thrice"))
