"""Queries over tickets as they were read, and over what lines say they bought or consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.money import doubtful, line_ttc
from ledgerloom.operators import tickets as ops
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query

D, M = "double", "decimal(14,2)"

#: A ticket's items with what they cost; a name has one price.
ITEMS = """
one AS (SELECT invoice_id AS ticket, line AS item, min(product_id) AS product_id FROM lines GROUP BY 1, 2),
items AS (SELECT ticket, item, product_id, raw_name AS name, CAST(length(raw_name) * 3.25 + ascii(raw_name) AS DECIMAL(14,2)) AS price, item = min(item) OVER (PARTITION BY ticket) AS is_first, item = max(item) OVER (PARTITION BY ticket) AS is_last FROM one JOIN products USING (product_id))
"""


def _items(spark, sf_dir):
    one = views.lines(spark, sf_dir).groupBy(F.col("invoice_id").alias("ticket"), F.col("line").alias("item")).agg(F.min("product_id").alias("product_id"))
    ends = one.groupBy("ticket").agg(F.min("item").alias("least"), F.max("item").alias("most"))
    price = (F.length("raw_name") * F.lit("3.25").cast("decimal(4,2)") + F.ascii("raw_name")).cast(M)
    rows = one.join(views.products(spark, sf_dir).select("product_id", "raw_name"), "product_id").join(ends, "ticket")
    return rows.select("ticket", "item", "product_id", F.col("raw_name").alias("name"), price.alias("price"), (F.col("item") == F.col("least")).alias("is_first"), (F.col("item") == F.col("most")).alias("is_last"))


@query(f"""
WITH {ITEMS}, read AS (SELECT *, CASE WHEN ticket % 4 = 0 AND is_first THEN CAST('7' || CAST(price AS VARCHAR) AS DECIMAL(14,2)) WHEN ticket % 4 = 1 AND is_first THEN price - 4.50 WHEN ticket % 4 = 2 AND (is_first OR is_last) THEN price - 2 ELSE price END AS total FROM items),
alike(a, b) AS (VALUES ('hot widget', 'old widget'), ('red widget', 'large widget'), ('red widget', 'old widget'), ('red widget', 'new widget'), ('red plate', 'large plate'), ('red gizmo', 'large gizmo'), ('red anvil', 'large anvil'), ('old widget', 'cold widget'), ('old plate', 'cold plate'), ('old gear', 'cold gear'), ('old bolt', 'cold bolt'), ('old rod', 'cold rod'), ('old ring', 'cold ring'), ('old gizmo', 'cold gizmo'), ('old anvil', 'cold anvil')),
near AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike UNION SELECT DISTINCT name, name FROM items), gaps AS (SELECT ticket, sum(price) - sum(total) AS gap FROM read GROUP BY 1 HAVING sum(price) <> sum(total)),
ways AS (SELECT r.ticket, r.item, r.total AS was, r.total + gap AS total FROM read r JOIN gaps g USING (ticket) WHERE EXISTS (SELECT 1 FROM read o JOIN near ON o.name = b WHERE o.ticket = r.ticket AND o.item <> r.item AND a = r.name AND o.total = r.total + gap)
  OR (length(CAST(r.total AS VARCHAR)) >= 5 AND TRY_CAST(substr(CAST(r.total AS VARCHAR), 2) AS DECIMAL(14,2)) = r.total + gap) OR (length(CAST(r.total AS VARCHAR)) >= 6 AND TRY_CAST(substr(CAST(r.total AS VARCHAR), 3) AS DECIMAL(14,2)) = r.total + gap))
SELECT ticket, min(item) AS item, CAST(min(was) AS DOUBLE) AS was, CAST(min(total) AS DOUBLE) AS total FROM ways GROUP BY 1 HAVING count(*) = 1 AND min(total) > 0
""")
def ticket_repairs(spark, sf_dir):
    """Tickets with an amount misread, put right where one correction alone makes them add up."""
    t, price = F.col("ticket") % 4, F.col("price")
    total = F.when((t == 0) & F.col("is_first"), F.concat(F.lit("7"), price.cast("string")).cast(M)).when((t == 1) & F.col("is_first"), price - F.lit("4.50").cast("decimal(4,2)")).when((t == 2) & (F.col("is_first") | F.col("is_last")), price - 2).otherwise(price)
    items = _items(spark, sf_dir)
    read = items.select("ticket", "item", "name", total.alias("total"), F.lit(None).cast("int").alias("count"))
    out = ops.repaired(read, items.groupBy("ticket").agg(F.sum("price").alias("target")))
    return out.select("ticket", "item", F.col("was").cast(D).alias("was"), F.col("total").cast(D).alias("total"))


@query(f"""
WITH {ITEMS}, buckets AS (SELECT ticket, coalesce(sum(price) FILTER (WHERE product_id % 3 = 0), 0) AS first, coalesce(sum(price) FILTER (WHERE product_id % 3 <> 0), 0) AS second FROM items GROUP BY 1),
groups AS (SELECT ticket, name, price AS net, count(*) AS n, row_number() OVER (PARTITION BY ticket ORDER BY name, price) AS i, count(*) OVER (PARTITION BY ticket) AS k FROM items GROUP BY ticket, name, price),
ways(ticket, i, s, rest, taken) AS (SELECT DISTINCT ticket, CAST(0 AS BIGINT), CAST(0 AS DECIMAL(14,2)), CAST(0 AS DECIMAL(14,2)), CAST([] AS BIGINT[]) FROM items UNION ALL
  SELECT ticket, i, CAST(s + net * t AS DECIMAL(14,2)), CAST(rest + net * (n - t) AS DECIMAL(14,2)), list_append(taken, t) FROM (SELECT w.ticket, g.i, s, rest, net, n, taken, unnest(range(n + 1)) AS t FROM ways w JOIN groups g ON g.ticket = w.ticket AND g.i = w.i + 1)),
good AS (SELECT w.ticket, min(taken) AS taken FROM ways w JOIN buckets b USING (ticket) JOIN (SELECT DISTINCT ticket, k FROM groups) g ON g.ticket = w.ticket AND w.i = g.k WHERE abs(s - first) <= 0.01 AND abs(rest - second) <= 0.01 GROUP BY 1 HAVING count(*) = 1)
SELECT ticket, name, CAST(net AS DOUBLE) AS net, CAST(n AS INTEGER) AS n, CAST(taken[i] AS INTEGER) AS n_first FROM good JOIN groups USING (ticket)
""")
def ticket_rates(spark, sf_dir):
    """Which items of a ticket have the first of its two rates, from the sums alone."""
    items, first = _items(spark, sf_dir), F.col("product_id") % 3 == 0
    buckets = items.groupBy("ticket").agg(F.sum(F.when(first, F.col("price")).otherwise(0)).alias("first"), F.sum(F.when(first, 0).otherwise(F.col("price"))).alias("second"))
    return ops.split_rates(items.select("ticket", "name", F.col("price").alias("net")), buckets).withColumn("net", F.col("net").cast(D))


@query("""
WITH p AS (SELECT article, quantity, ht, vat, CASE WHEN (invoice_id + line) % 3 = 0 THEN round(ht * (1 + vat), 2) END AS printed, CASE WHEN line = 1 THEN 1.50 END AS promotion FROM movements JOIN products USING (product_id) WHERE kind = 'PURCHASE')
SELECT article, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(ht) AS DOUBLE) AS ht, CAST(sum(coalesce(printed - coalesce(promotion, 0), ht * (1 + vat))) AS DOUBLE) AS ttc, count(*) AS n_lines FROM p GROUP BY 1
""")
def bought_totals(spark, sf_dir):
    """What was bought of each article: TTC as printed less its promotion, else from HT and its rate."""
    ttc = F.col("ht") * (1 + F.col("vat"))
    rows = views.movements(spark, sf_dir).filter("kind = 'PURCHASE'").withColumn("printed", F.when((F.col("invoice_id") + F.col("line")) % 3 == 0, F.round(ttc, 2))).withColumn("promotion", F.when(F.col("line") == 1, F.lit("1.50").cast("decimal(6,2)")))
    per = rows.groupBy("product_id").agg(F.sum("quantity").alias("quantity"), F.sum("ht").alias("ht"), F.sum(line_ttc(F.col("printed"), F.col("promotion"), F.col("ht"), F.col("vat"))).alias("ttc"), F.count("*").alias("n"))
    return per.join(views.products(spark, sf_dir).select("product_id", "article"), "product_id").groupBy("article").agg(*(F.sum(c).cast(D).alias(c) for c in ("quantity", "ht", "ttc")), F.sum("n").alias("n_lines"))


@query("""
WITH c AS (SELECT product_id, CAST(sum(ht) AS DOUBLE) / nullif(CAST(sum(quantity) AS DOUBLE), 0) AS cost FROM lines WHERE flag <> 'R' GROUP BY 1),
t AS (SELECT l.invoice_id, l.line, l.product_id, CAST(l.ht AS DOUBLE) / nullif(CAST(l.quantity AS DOUBLE) * (CASE l.line WHEN 1 THEN 0.04 WHEN 2 THEN 24 WHEN 3 THEN 0 ELSE 1 END), 0) AS per_unit, CASE WHEN l.product_id % 10 = 0 THEN p_retailprice / 1.2 ELSE cost END AS reference FROM lines l LEFT JOIN c USING (product_id) JOIN part ON p_partkey = l.product_id WHERE l.flag = 'R')
SELECT invoice_id, line, product_id, CASE WHEN per_unit > 10 * reference THEN 'dear' WHEN per_unit * 10 < reference THEN 'cheap' END AS doubt FROM t WHERE per_unit > 0 AND reference > 0 AND (per_unit > 10 * reference OR per_unit * 10 < reference)
""")
def consumption_doubts(spark, sf_dir):
    """Lines whose money for each unit consumed is far from a recipe's menu price or an article's unit cost."""
    lines = views.lines(spark, sf_dir)
    cost = lines.filter("flag <> 'R'").groupBy("product_id").agg(F.try_divide(F.sum("ht").cast(D), F.sum("quantity").cast(D)).alias("cost"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_retailprice") / 1.2).alias("price_ht"))
    share = F.when(F.col("line") == 1, 0.04).when(F.col("line") == 2, 24.0).when(F.col("line") == 3, 0.0).otherwise(1.0)
    rows = lines.filter("flag = 'R'").join(prices, "product_id").join(cost, "product_id", "left")
    doubt = doubtful(F.try_divide(F.col("ht").cast(D), F.col("quantity").cast(D) * share), F.when(F.col("product_id") % 10 == 0, F.col("price_ht")).otherwise(F.col("cost")))
    return rows.select("invoice_id", "line", "product_id", doubt.alias("doubt")).filter("doubt is not null")
