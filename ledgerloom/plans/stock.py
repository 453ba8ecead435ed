"""Queries over the purchase ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import spreads, stock
from ledgerloom.sources import views

from .registry import query

D = "double"
START, END = date(1998, 1, 1), date(1999, 1, 1)


@query("""
SELECT article, CAST(sum(quantity * stock_equivalent) AS DOUBLE) AS quantity, CAST(sum(ht) AS DOUBLE) AS value_ht, CAST(sum(round(ht * (1 + vat), 2)) AS DOUBLE) AS value_ttc,
  coalesce(CAST(sum(ht) AS DOUBLE) / nullif(CAST(sum(quantity * stock_equivalent) AS DOUBLE), 0), 0) AS average_cost,
  CAST(sum(CASE WHEN kind = 'PURCHASE' THEN quantity * stock_equivalent END) AS DOUBLE) AS bought_quantity, CAST(sum(CASE WHEN kind = 'PURCHASE' THEN ht END) AS DOUBLE) AS bought_ht,
  max(CASE WHEN kind = 'PURCHASE' AND quantity > 0 THEN day END) AS last_purchase, count(*) AS n_movements
FROM movements JOIN products USING (product_id) GROUP BY article
""")
def stock_balance(spark, sf_dir):
    out = stock.ledger_totals(views.movements(spark, sf_dir), views.products(spark, sf_dir), "article")
    return out.select(
        "article", *(F.col(c).cast(D).alias(c) for c in ("quantity", "value_ht", "value_ttc")), stock.average_cost(F.col("value_ht"), F.col("quantity")).alias("average_cost"),
        *(F.col(c).cast(D).alias(c) for c in ("bought_quantity", "bought_ht")), "last_purchase", "n_movements",
    )


@query("""
SELECT coalesce(category, 'all') AS category, coalesce(article, 'all') AS article, CAST(sum(ht) AS DOUBLE) AS value_ht, CAST(sum(round(ht * (1 + vat), 2)) AS DOUBLE) AS value_ttc
FROM movements JOIN products USING (product_id) GROUP BY ROLLUP (category, article)
""")
def stock_value_by_category(spark, sf_dir):
    per = stock.ledger_totals(views.movements(spark, sf_dir), views.products(spark, sf_dir), "category", "article")
    out = per.rollup("category", "article").agg(F.sum("value_ht").cast(D).alias("value_ht"), F.sum("value_ttc").cast(D).alias("value_ttc"))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("article", F.lit("all")).alias("article"), "value_ht", "value_ttc")


@query("""
SELECT article, CAST(sum(CASE WHEN kind = 'PURCHASE' THEN quantity * stock_equivalent ELSE 0 END) AS DOUBLE) AS purchased, CAST(sum(CASE WHEN kind = 'LOSS' THEN -quantity * stock_equivalent ELSE 0 END) AS DOUBLE) AS lost,
  max(CASE WHEN kind = 'PURCHASE' AND quantity > 0 THEN day END) AS last_purchase
FROM movements JOIN products USING (product_id) WHERE day > DATE '1998-01-01' AND day <= DATE '1999-01-01' GROUP BY article
""")
def purchases_between_counts(spark, sf_dir):
    out = stock.between(views.movements(spark, sf_dir), views.products(spark, sf_dir), START, END)
    return out.select("article", F.col("purchased").cast(D).alias("purchased"), F.col("lost").cast(D).alias("lost"), "last_purchase")


@query("""
SELECT article, day, CAST(sum(abs(ht)) AS DOUBLE) / CAST(sum(abs(quantity)) AS DOUBLE) AS price, count(*) AS n_lines
FROM movements JOIN products USING (product_id) WHERE kind = 'PURCHASE' GROUP BY article, day
""")
def article_price_history(spark, sf_dir):
    price = F.col("ht").cast(D) / F.col("quantity").cast(D)
    rows = views.movements(spark, sf_dir).filter("kind = 'PURCHASE'").join(views.products(spark, sf_dir).select("product_id", "article"), "product_id").withColumn("price", price).withColumn("value", F.col("ht"))
    return stock.price_points(rows, "article", "day")


@query("""
SELECT product_id, count(DISTINCT discount) AS n_ratios, count(DISTINCT discount) <= 1 AS discrete FROM lines GROUP BY product_id
""")
def discrete_vs_measured(spark, sf_dir):
    out = views.lines(spark, sf_dir).groupBy("product_id").agg(F.count_distinct("discount").alias("n_ratios"))
    return out.withColumn("discrete", F.col("n_ratios") <= 1)


@query("""
WITH sizes AS (SELECT article, quantity AS size, count(*) AS n FROM lines JOIN products USING (product_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY n DESC, size DESC) AS r FROM sizes)
SELECT article, CAST(size AS DOUBLE) AS size, n AS n_lines FROM ranked WHERE r = 1
""")
def usual_container(spark, sf_dir):
    counted = views.lines(spark, sf_dir).groupBy("product_id", "quantity").agg(F.count("*").alias("m"))
    sizes = counted.join(views.products(spark, sf_dir), "product_id").groupBy("article", F.col("quantity").alias("size")).agg(F.sum("m").alias("n"))
    return sizes.groupBy("article").agg(F.max_by("size", F.struct("n", "size")).cast(D).alias("size"), F.max("n").alias("n_lines"))


@query("SELECT product_id, min(day) AS first_purchase, count(*) AS n_lines FROM lines WHERE flag <> 'R' GROUP BY product_id")
def first_purchase(spark, sf_dir):
    return views.lines(spark, sf_dir).filter("flag <> 'R'").groupBy("product_id").agg(F.min("day").alias("first_purchase"), F.count("*").alias("n_lines"))


def _ladder(spark, sf_dir):
    rows = views.movements(spark, sf_dir).filter("kind = 'PURCHASE' and quantity > 0")
    # Every 97th product's lines are undated: they count as the oldest.
    day = F.when(F.col("product_id") % 97 == 0, F.lit(None).cast("date")).otherwise(F.col("day"))
    return rows.select("product_id", day.alias("day"), F.struct("invoice_id", "line", "supplier_id", "ht", "quantity").alias("tie"), "quantity", F.col("ht").alias("cost"))


def _counts(spark, sf_dir):
    """A count of each product: three fifths of what was bought, one and a half times for every seventh."""
    part = F.when(F.col("product_id") % 7 == 0, F.lit("1.5")).otherwise(F.lit("0.6")).cast("decimal(3,1)")
    return views.movements(spark, sf_dir).filter("kind = 'PURCHASE'").groupBy("product_id").agg(F.sum(F.abs("quantity")).alias("b")).select("product_id", (F.col("b") * part).cast("decimal(18,3)").alias("counted"))


LAYERS = """
counts AS (SELECT product_id, CAST(sum(abs(quantity)) * CASE WHEN product_id % 7 = 0 THEN 1.5 ELSE 0.6 END AS DECIMAL(18,3)) AS counted FROM movements WHERE kind = 'PURCHASE' GROUP BY product_id),
ladder AS (SELECT product_id, CASE WHEN product_id % 97 = 0 THEN NULL ELSE day END AS day, invoice_id, line, supplier_id, ht, quantity FROM movements WHERE kind = 'PURCHASE' AND quantity > 0),
run AS (SELECT *, sum(quantity) OVER (PARTITION BY product_id ORDER BY day DESC NULLS LAST, invoice_id DESC, line DESC, supplier_id DESC, ht DESC, quantity DESC ROWS UNBOUNDED PRECEDING) AS upto FROM ladder JOIN counts USING (product_id)),
layers AS (SELECT *, upto - quantity AS before, least(quantity, counted - (upto - quantity)) AS taken FROM run WHERE upto - quantity < counted)
"""


@query(f"""
WITH {LAYERS},
worth AS (SELECT *, CAST(ht * 100 AS HUGEINT) * CAST(taken * 1000 AS HUGEINT) * 1000 // CAST(quantity * 1000 AS HUGEINT) AS w, CAST(ht * 100 AS HUGEINT) * CAST(greatest(counted - upto, 0) * 1000 AS HUGEINT) * 1000 // CAST(quantity * 1000 AS HUGEINT) AS r FROM layers),
per AS (SELECT product_id, sum(w) AS covered, sum(taken) AS taken, arg_max(r, before) AS rest, count(*) AS n FROM worth GROUP BY product_id)
SELECT product_id, CAST(counted AS DOUBLE) AS counted, CAST(coalesce(covered, 0) + coalesce(rest, 0) AS DOUBLE) / 100000 AS value_ht,
  CAST(counted - coalesce(taken, 0) AS DOUBLE) AS shortfall, coalesce(n, 0) AS n_layers FROM counts LEFT JOIN per USING (product_id)
""")
def fifo_valuation(spark, sf_dir):
    return stock.fifo_valuation(_ladder(spark, sf_dir), _counts(spark, sf_dir), "product_id")


@query(f"""
WITH {LAYERS}
SELECT product_id, invoice_id, line, day, CAST(taken AS DOUBLE) AS taken, CAST(ht AS DOUBLE) / CAST(quantity AS DOUBLE) AS unit_cost FROM layers
""")
def fifo_sources(spark, sf_dir):
    out = stock.fifo_layers(_ladder(spark, sf_dir), _counts(spark, sf_dir), "product_id")
    return out.select("product_id", "tie.invoice_id", "tie.line", "day", F.col("taken").cast(D).alias("taken"), (F.col("cost").cast(D) / F.col("quantity").cast(D)).alias("unit_cost"))


@query("""
WITH rates AS (SELECT invoice_id, vat, sum(round(ht * (1 + vat), 2)) AS ttc FROM lines GROUP BY 1, 2),
bought AS (SELECT invoice_id, CAST(sum(ttc) AS DOUBLE) AS total_ttc, CAST(sum(round(ttc / (1 + vat), 2)) AS DOUBLE) AS total_ht, count(*) AS n_rates FROM rates GROUP BY 1)
SELECT invoice_id, total_ttc, round(total_ht, 2) AS total_ht, n_rates FROM bought
""")
def invoice_totals_by_rate(spark, sf_dir):
    """TTC to HT one rate at a time: each rate's sum is divided once."""
    rates = views.lines(spark, sf_dir).groupBy("invoice_id", "vat").agg(F.sum(F.round(F.col("ht") * (1 + F.col("vat")), 2)).alias("ttc"))
    ht = F.round((F.col("ttc").cast(D) / (1 + F.col("vat")).cast(D)), 2)
    return rates.groupBy("invoice_id").agg(F.sum("ttc").cast(D).alias("total_ttc"), F.round(F.sum(ht), 2).alias("total_ht"), F.count("*").alias("n_rates"))


@query("""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line, product_id, supplier_id, day, ht, quantity, discount, vat) AS pos, CAST((invoice_id % 9973 - 4000) / 100.0 AS DECIMAL(12,2)) AS charge FROM lines),
w AS (SELECT *, CAST(CASE WHEN line % 5 = 0 THEN 0 ELSE ht END AS DECIMAL(12,2)) AS weight FROM placed),
s AS (SELECT *, sum(weight) OVER (PARTITION BY invoice_id) AS total FROM w),
c AS (SELECT *, CAST(floor(abs(charge) * 100 * weight / nullif(total, 0)) AS BIGINT) AS cut, CAST(CAST(abs(charge) * 100 AS BIGINT) AS HUGEINT) * CAST(weight * 100 AS HUGEINT) AS num, CAST(total * 100 AS HUGEINT) AS den FROM s),
e AS (SELECT *, CASE WHEN den > 0 THEN num // den ELSE 0 END AS whole, CASE WHEN den > 0 THEN num % den ELSE 0 END AS rest FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY weight > 0 DESC, rest DESC, pos) AS rank, CAST(abs(charge) * 100 AS HUGEINT) - sum(whole) OVER (PARTITION BY invoice_id) AS missing FROM e)
SELECT invoice_id, pos AS position, CAST(charge AS DOUBLE) AS charge, (CASE WHEN charge < 0 THEN -1 ELSE 1 END) * CAST(whole + CASE WHEN weight > 0 AND rank <= missing THEN 1 ELSE 0 END AS DOUBLE) / 100 + 0.0 AS share FROM r
""")
def charge_spread(spark, sf_dir):
    """A charge of each invoice over its goods (every fifth line carries none), to the cent."""
    order = Window.partitionBy("invoice_id").orderBy("line", "product_id", "supplier_id", "day", "ht", "quantity", "discount", "vat")
    rows = views.lines(spark, sf_dir).withColumn("position", F.row_number().over(order)).withColumn("charge", ((F.col("invoice_id") % 9973 - 4000) / 100).cast("decimal(12,2)"))
    rows = rows.withColumn("weight", F.when(F.col("line") % 5 == 0, F.lit(0)).otherwise(F.col("ht")).cast("decimal(12,2)"))
    out = spreads.largest_remainder(rows, "invoice_id", "position", "charge", "weight")
    return out.select("invoice_id", F.col("position").cast("long").alias("position"), F.col("charge").cast(D).alias("charge"), (F.col("share").cast(D) + F.lit(0.0)).alias("share"))


@query("""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line, product_id, supplier_id, day, ht, quantity, discount, vat) AS pos FROM lines),
w AS (SELECT *, CAST(CASE WHEN line % 5 = 0 THEN 0 ELSE quantity END AS DECIMAL(12,2)) AS weight, CAST((invoice_id % 997) / 10.0 AS DECIMAL(12,2)) AS promo FROM placed), s AS (SELECT *, sum(weight) OVER (PARTITION BY invoice_id) AS total FROM w),
e AS (SELECT *, CASE WHEN total > 0 AND promo <= total THEN CAST(promo * 100 AS HUGEINT) ELSE 0 END AS cents, CAST(weight * 100 AS HUGEINT) AS wc, CAST(total * 100 AS HUGEINT) AS den FROM s),
q AS (SELECT *, CASE WHEN den > 0 THEN cents * wc // den ELSE 0 END AS whole, CASE WHEN den > 0 THEN cents * wc % den ELSE 0 END AS rest FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY weight > 0 DESC, rest DESC, pos) AS rank, cents - sum(whole) OVER (PARTITION BY invoice_id) AS missing FROM q)
SELECT invoice_id, pos AS position, cents = 0 AND promo > 0 AS refused, CAST(whole + CASE WHEN weight > 0 AND rank <= missing THEN 1 ELSE 0 END AS DOUBLE) / 100 AS share FROM r
""")
def promotion_spread(spark, sf_dir):
    """A promotion of each ticket over its items, unless it is more than all of them."""
    order = Window.partitionBy("invoice_id").orderBy("line", "product_id", "supplier_id", "day", "ht", "quantity", "discount", "vat")
    rows = views.lines(spark, sf_dir).withColumn("position", F.row_number().over(order)).withColumn("promo", (F.col("invoice_id") % 997 / 10).cast("decimal(12,2)"))
    rows = rows.withColumn("weight", F.when(F.col("line") % 5 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("decimal(12,2)"))
    out = spreads.promotion(rows, "invoice_id", "position", "promo", "weight").withColumn("total", F.sum("weight").over(Window.partitionBy("invoice_id")))
    refused = (F.col("promo") > 0) & ((F.col("total") <= 0) | (F.col("promo") > F.col("total")))
    return out.select("invoice_id", F.col("position").cast("long").alias("position"), refused.alias("refused"), F.col("share").cast(D).alias("share"))


@query("""
WITH parts AS (SELECT supplier_id, category, article, sum(ht) AS amount FROM lines JOIN products USING (product_id) GROUP BY 1, 2, 3),
s AS (SELECT *, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY supplier_id) AS DOUBLE) < 0.02 AS small FROM parts),
f AS (SELECT *, CASE WHEN small AND sum(small::INT) OVER (PARTITION BY supplier_id) > 1 THEN 'others' ELSE article END AS slice FROM s)
SELECT supplier_id, slice, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n_parts FROM f GROUP BY 1, 2
""")
def share_pie(spark, sf_dir):
    parts = views.lines(spark, sf_dir).join(views.products(spark, sf_dir), "product_id").groupBy("supplier_id", "article").agg(F.sum("ht").alias("amount"))
    return spreads.pie(parts, "supplier_id", "article", "amount", 0.02).withColumn("amount", F.col("amount").cast(D))


@query("""
WITH places AS (SELECT invoice_id, CASE WHEN supplier_id % 10 = 0 THEN 'charges' ELSE 'goods' END AS family, CASE WHEN supplier_id % 10 = 0 THEN 'supplier ' || supplier_id ELSE category END AS place, sum(ht) AS ht, sum(round(ht * (1 + vat), 2)) AS ttc
  FROM lines JOIN products USING (product_id) GROUP BY 1, 2, 3),
g AS (SELECT family, place, sum(ht) AS ht, sum(ttc) AS ttc, count(*) AS n_invoices FROM places GROUP BY 1, 2)
SELECT family, place, CAST(ht AS DOUBLE) AS ht, CAST(ttc AS DOUBLE) AS ttc, n_invoices, CAST(ht AS DOUBLE) / CAST(sum(ht) OVER () AS DOUBLE) AS share FROM g
""")
def spend_places(spark, sf_dir):
    """Where invoices' money goes: charge suppliers as they are, goods by category, with shares of the whole."""
    charge = F.col("supplier_id") % 10 == 0
    rows = views.lines(spark, sf_dir).join(views.products(spark, sf_dir), "product_id")
    rows = rows.withColumn("family", F.when(charge, "charges").otherwise("goods")).withColumn("place", F.when(charge, F.concat(F.lit("supplier "), "supplier_id")).otherwise(F.col("category")))
    per = rows.groupBy("invoice_id", "family", "place").agg(F.sum("ht").alias("ht"), F.sum(F.round(F.col("ht") * (1 + F.col("vat")), 2)).alias("ttc"))
    g = per.groupBy("family", "place").agg(F.sum("ht").alias("ht"), F.sum("ttc").alias("ttc"), F.count("*").alias("n_invoices"))
    # One row a place: small whatever the input.
    share = F.col("ht").cast(D) / F.sum("ht").over(Window.partitionBy(F.lit(1))).cast(D)
    return g.select("family", "place", F.col("ht").cast(D).alias("ht"), F.col("ttc").cast(D).alias("ttc"), "n_invoices", share.alias("share"))


@query("""
WITH seen AS (SELECT l.*, max(day) OVER () AS today FROM lines l), bound AS (SELECT max(day) AS today FROM lines),
c AS (SELECT supplier_id, invoice_id, day, ht, vat, day >= today - INTERVAL 365 DAY AS recent FROM lines, bound WHERE supplier_id % 10 = 0)
SELECT supplier_id, CAST(coalesce(sum(CASE WHEN recent THEN round(ht * (1 + vat), 2) END), 0) AS DOUBLE) AS year_ttc, count(DISTINCT CASE WHEN recent THEN invoice_id END) AS year_documents,
  count(DISTINCT invoice_id) AS documents, max(day) AS last_day, count(*) AS n_items FROM c GROUP BY supplier_id
""")
def charge_suppliers_12m(spark, sf_dir):
    rows = views.lines(spark, sf_dir).filter(F.col("supplier_id") % 10 == 0)
    today = views.lines(spark, sf_dir).agg(F.max("day").alias("today"))
    rows = rows.join(F.broadcast(today)).withColumn("recent", F.col("day") >= F.date_sub("today", 365))
    ttc = F.round(F.col("ht") * (1 + F.col("vat")), 2)
    return rows.groupBy("supplier_id").agg(
        F.coalesce(F.sum(F.when(F.col("recent"), ttc)), F.lit(0)).cast(D).alias("year_ttc"), F.count_distinct(F.when(F.col("recent"), F.col("invoice_id"))).alias("year_documents"),
        F.count_distinct("invoice_id").alias("documents"), F.max("day").alias("last_day"), F.count("*").alias("n_items"),
    )


@query("""
WITH r AS (SELECT supplier_id, article, sum(CASE WHEN flag = 'R' THEN quantity ELSE 0 END) AS returned, sum(CASE WHEN flag <> 'R' THEN quantity ELSE 0 END) AS bought,
  CASE WHEN min(vat) = max(vat) THEN CAST(min(vat) AS DOUBLE) END AS agreed_rate FROM lines JOIN products USING (product_id) GROUP BY 1, 2)
SELECT supplier_id, article, CAST(returned AS DOUBLE) AS returned, CAST(bought AS DOUBLE) AS bought, CAST(bought - returned AS DOUBLE) AS difference, agreed_rate FROM r
""")
def returns_vs_purchases(spark, sf_dir):
    """What came back against what was bought, by store and article; a rate only where all lines agree on it."""
    rows = views.lines(spark, sf_dir).join(views.products(spark, sf_dir), "product_id")
    r = rows.groupBy("supplier_id", "article").agg(F.sum(F.when(F.col("flag") == "R", F.col("quantity")).otherwise(0)).alias("returned"), F.sum(F.when(F.col("flag") != "R", F.col("quantity")).otherwise(0)).alias("bought"), F.min("vat").alias("a"), F.max("vat").alias("b"))
    return r.select("supplier_id", "article", F.col("returned").cast(D).alias("returned"), F.col("bought").cast(D).alias("bought"), (F.col("bought") - F.col("returned")).cast(D).alias("difference"), F.when(F.col("a") == F.col("b"), F.col("a").cast(D)).alias("agreed_rate"))
