"""Queries over invoices as documents: totals, prices, labels, names, chains, differences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import parse
from ledgerloom.operators import invoices, names
from ledgerloom.sources import recipes as src
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query
from .till import RECIPES, _sold

D = "double"


@query("""
WITH p AS (SELECT invoice_id AS doc, ht, vat, CASE WHEN invoice_id % 3 = 0 OR line % 2 = 0 THEN round(ht * (1 + vat), 2) END AS printed, CASE WHEN line = 1 THEN 1.50 ELSE 0 END AS promotion FROM lines),
per AS (SELECT doc, bool_and(printed IS NOT NULL) AS all_printed, sum(printed - promotion) AS p, sum(ht * (1 + vat)) AS t, count(DISTINCT vat) AS rates FROM p GROUP BY 1),
s AS (SELECT *, CASE WHEN doc % 2 = 0 THEN round(t, 2) ELSE round(t, 2) - 1.5 END AS printed_total FROM per),
r AS (SELECT *, CASE WHEN all_printed THEN CASE WHEN abs(printed_total - p) <= 0.05 THEN 'stated' ELSE 'printed' END ELSE CASE WHEN abs(printed_total - t) <= 0.01 * greatest(rates, 1) THEN 'stated' ELSE 'computed' END END AS rule FROM s)
SELECT doc, rule, CAST(CASE rule WHEN 'stated' THEN printed_total WHEN 'printed' THEN p ELSE round(t, 2) END AS DOUBLE) AS total FROM r
""")
def invoice_total_rules(spark, sf_dir):
    ttc = F.round(F.col("ht") * (1 + F.col("vat")), 2)
    rows = views.lines(spark, sf_dir).select(F.col("invoice_id").alias("doc"), "ht", "vat", F.when((F.col("invoice_id") % 3 == 0) | (F.col("line") % 2 == 0), ttc).alias("printed"), F.when(F.col("line") == 1, F.lit("1.50")).otherwise("0").cast("decimal(6,2)").alias("promotion"))
    t = F.round(F.sum(F.col("ht") * (1 + F.col("vat"))), 2)
    stated = rows.groupBy("doc").agg(t.alias("t")).select("doc", F.when(F.col("doc") % 2 == 0, F.col("t")).otherwise(F.col("t") - F.lit("1.5").cast("decimal(4,2)")).alias("printed_total"))
    return invoices.totals(rows, stated).select("doc", "rule", F.col("total").cast(D).alias("total"))


@query("""
WITH d AS (SELECT product_id, day, sum(quantity) AS q, sum(ht) AS r FROM lines WHERE flag <> 'R' GROUP BY 1, 2), p AS (SELECT product_id, CAST((CAST(r * 100 AS HUGEINT) * 2000 + CAST(q * 1000 AS HUGEINT)) // (2 * CAST(q * 1000 AS HUGEINT)) AS DOUBLE) / 100 AS price, sum(q) AS units FROM d WHERE q > 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY units DESC, price DESC) AS r FROM p) SELECT product_id, price, CAST(units AS DOUBLE) AS units FROM k WHERE r = 1
""")
def usual_till_price(spark, sf_dir):
    rows = views.lines(spark, sf_dir).filter("flag <> 'R'").select("product_id", "day", "quantity", F.col("ht").alias("revenue"))
    return invoices.usual_price(rows, "product_id").withColumn("units", F.col("units").cast(D))


@query("""
WITH c AS (SELECT supplier_id, min(day) AS valid_from, 'Y' || year(day) AS label FROM lines WHERE supplier_id % 3 <> 0 GROUP BY supplier_id, year(day)), a AS (SELECT invoice_id, line, product_id, supplier_id, day FROM lines WHERE flag = 'R')
SELECT a.invoice_id, a.line, a.product_id, a.supplier_id, a.day, c.label FROM a ASOF LEFT JOIN c ON a.supplier_id = c.supplier_id AND a.day >= c.valid_from
""")
def label_as_of(spark, sf_dir):
    """The price label of a supplier that was valid on each return's day."""
    rows = views.lines(spark, sf_dir)
    labels = rows.filter("supplier_id % 3 <> 0").groupBy("supplier_id", F.year("day").alias("y")).agg(F.min("day").alias("valid_from")).select("supplier_id", "valid_from", F.concat(F.lit("Y"), F.col("y").cast("string")).alias("label"))
    return invoices.valid_at(rows.filter("flag = 'R'").select("invoice_id", "line", "product_id", "supplier_id", "day"), labels, "supplier_id")


@query(f"""
WITH {RECIPES}, g AS (SELECT recipe_id, grp, list_sort(list(product_id)) AS options FROM ingredients GROUP BY 1, 2), a AS (SELECT recipe_id, g1.options AS o1, g2.options AS o2, g3.options AS o3 FROM (SELECT * FROM g WHERE grp = 1) g1 JOIN (SELECT * FROM g WHERE grp = 2) g2 USING (recipe_id) JOIN (SELECT * FROM g WHERE grp = 3) g3 USING (recipe_id)),
v AS (SELECT *, unnest(range(len(o1) * len(o2) * len(o3))) AS n FROM a)
SELECT recipe_id, n, o1[n % len(o1) + 1] || ' ' || o2[n // len(o1) % len(o2) + 1] || ' ' || o3[n // (len(o1) * len(o2)) % len(o3) + 1] AS products FROM v
""")
def recipe_variations(spark, sf_dir):
    """Every way to make each recipe, by number."""
    groups = src.ingredients(spark, sf_dir).groupBy("recipe_id", "grp").agg(F.array_sort(F.collect_list("product_id")).alias("options"))
    out = invoices.variation_at(groups)
    return out.select("recipe_id", "n", F.array_join(F.transform("products", lambda x: x.cast("string")), " ").alias("products"))


@query("""
WITH p AS (SELECT line_id AS id, lead(line_id) OVER (PARTITION BY payee_id ORDER BY line_id) AS nxt, payee_id FROM bank_lines), r AS (SELECT id, CASE WHEN payee_id % 2 = 0 THEN nxt END AS replaced_by FROM p),
f(id, final_id) AS (SELECT id, id FROM r WHERE replaced_by IS NULL UNION ALL SELECT r.id, f.final_id FROM r JOIN f ON r.replaced_by = f.id) SELECT id, final_id FROM f
""")
def final_versions(spark, sf_dir):
    """Where each line's chain of replacements ends."""
    rows = views.bank_lines(spark, sf_dir).withColumn("nxt", F.lead("line_id").over(Window.partitionBy("payee_id").orderBy("line_id")))
    return invoices.final_versions(rows.select(F.col("line_id").alias("id"), F.when(F.col("payee_id") % 2 == 0, F.col("nxt")).alias("replaced_by")))


@query("""
WITH h AS (SELECT event_id, user_id, sha256(CAST(event_id AS VARCHAR) || event_type) AS hash FROM events), c AS (SELECT *, lag(hash, 1, '') OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM h),
s AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'x' ELSE expected END AS previous_hash FROM c) SELECT event_id, user_id, hash, previous_hash, expected FROM s WHERE previous_hash <> expected
""")
def hash_chain_check(spark, sf_dir):
    """Links of each user's chain of events that do not hold; every 101st was tampered with."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256).alias("hash"))
    rows = rows.withColumn("previous_hash", F.when(F.col("event_id") % 101 == 0, "x").otherwise(F.coalesce(F.lag("hash").over(w), F.lit(""))))
    return invoices.broken_links(rows, "user_id", "event_id")


@query("""
WITH a AS (SELECT product, day, quantity, revenue FROM till_days WHERE day < DATE '2024-01-25'), b AS (SELECT product, day, quantity + CASE WHEN product = 'click' THEN 1 ELSE 0 END AS quantity, CASE WHEN day = DATE '2024-01-10' THEN revenue + 1 ELSE revenue END AS revenue FROM till_days WHERE day >= DATE '2024-01-05'),
j AS (SELECT coalesce(a.product, b.product) AS product, coalesce(a.day, b.day) AS day, CASE WHEN b.product IS NULL THEN 'only_stored' WHEN a.product IS NULL THEN 'only_made' ELSE 'changed' END AS kind,
  CASE WHEN a.product IS NULL OR b.product IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.quantity IS DISTINCT FROM b.quantity THEN 'quantity' END, CASE WHEN a.revenue IS DISTINCT FROM b.revenue THEN 'revenue' END], lambda x: x IS NOT NULL), ',') END AS columns FROM a FULL JOIN b ON a.product = b.product AND a.day = b.day)
SELECT * FROM j WHERE kind <> 'changed' OR columns <> ''
""")
def stored_changes(spark, sf_dir):
    """What reading again would change."""
    rows = views.till_days(spark, sf_dir)
    made = rows.filter("day >= date'2024-01-05'").select("product", "day", (F.col("quantity") + F.when(F.col("product") == "click", 1).otherwise(0)).alias("quantity"), (F.col("revenue") + F.when(F.col("day") == F.lit("2024-01-10").cast("date"), 1).otherwise(0)).cast("decimal(24,2)").alias("revenue"))
    stored = rows.filter("day < date'2024-01-25'").withColumn("revenue", F.col("revenue").cast("decimal(24,2)"))
    return invoices.differences(stored, made, ["product", "day"], ["quantity", "revenue"])


@query("""
WITH n AS (SELECT p_partkey AS id, upper(p_name) AS name FROM part), k AS (SELECT lower(trim(p_name)) AS fold, arg_min(p_partkey, (p_partkey % 3) * 1000000000 + p_partkey) AS target FROM part GROUP BY 1)
SELECT id, name, target FROM n LEFT JOIN k ON lower(trim(name)) = fold
""")
def name_precedence(spark, sf_dir):
    """A printed name's product: of several with that name, the one whose link comes first."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("target"), (F.col("p_partkey") % 3).alias("precedence"))
    return names.resolve(part.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name")), known)


@query("""
WITH r AS (SELECT p_partkey AS row_id, p_name AS text FROM part), c AS (SELECT DISTINCT substr(p_name, 1, 3 + CAST(p_partkey % 6 AS INT)) AS prefix FROM part WHERE p_partkey % 5 = 0)
SELECT row_id, text, (SELECT arg_max(prefix, length(prefix)) FROM c WHERE starts_with(text, prefix)) AS claim FROM r
""")
def longest_prefix_claim(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    claims = part.filter("p_partkey % 5 = 0").select(F.substring(F.col("p_name"), F.lit(1), (3 + F.col("p_partkey") % 6).cast("int")).alias("prefix"))
    return names.longest_prefix(part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text")), claims, 8)


@query()
def ocr_match(spark, sf_dir):
    """Names read with a look-alike or one wrong letter, matched to the products of the same type."""
    part = table(spark, sf_dir, "part").withColumn("supplier_id", F.col("p_type"))
    known = part.groupBy("supplier_id", F.upper("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    read = part.select("supplier_id", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.translate(F.upper("p_name"), "OIS", "015")).otherwise(F.regexp_replace(F.upper("p_name"), "E", "F")).alias("name"))
    return names.misread_match(read, known)


@query("""
SELECT array_to_string(list_sort(regexp_extract_all(upper(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_size ELSE p_size || ' ' || p_name END), '[A-Z0-9]+')), ' ') AS key, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1
""")
def same_words(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", size)).otherwise(F.concat_ws(" ", size, "p_name"))
    return names.same_words(part.select(F.col("p_partkey").alias("id"), name.alias("name")))


@query("""
WITH c AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'CB(4,5' WHEN event_id % 2 = 0 THEN 'CB(' || replace(printf('%.2f', value), '.', ',') || ')/Cash(2,00)' ELSE 'Cash(' || replace(printf('%.2f', value), '.', ',') || ')' END AS cell, value FROM events),
p AS (SELECT unnest(CASE WHEN event_id % 50 = 0 THEN [] WHEN event_id % 2 = 0 THEN [{'m': 'CB', 'a': CAST(printf('%.2f', value) AS DECIMAL(12,2))}, {'m': 'Cash', 'a': CAST(2 AS DECIMAL(12,2))}] ELSE [{'m': 'Cash', 'a': CAST(printf('%.2f', value) AS DECIMAL(12,2))}] END) AS x FROM c)
SELECT x.m AS method, count(*) AS n, CAST(sum(x.a) AS DOUBLE) AS total FROM p GROUP BY 1
""")
def payment_cells(spark, sf_dir):
    """Payments read from cells; a cell that does not read whole gives none."""
    v = F.translate(F.format_string("%.2f", "value"), ".", ",")
    i = F.col("event_id")
    cell = F.when(i % 50 == 0, "CB(4,5").when(i % 2 == 0, F.concat(F.lit("CB("), v, F.lit(")/Cash(2,00)"))).otherwise(F.concat(F.lit("Cash("), v, F.lit(")")))
    rows = table(spark, sf_dir, "events").select(F.explode(parse.payments(cell)).alias("p"))
    return rows.groupBy("p.method").agg(F.count("*").alias("n"), F.sum("p.amount").cast(D).alias("total"))


@query("""
WITH l AS (SELECT line_id, day, 'CARTE ' || strftime(day - CAST(line_id % 5 AS INTEGER), '%d/%m') || ' SHOP' AS label FROM bank_lines) SELECT line_id, CAST(day - CAST(line_id % 5 AS INTEGER) AS DATE) AS card_day, day FROM l
""")
def card_dates(spark, sf_dir):
    """The card's own day, read back from labels that have no year."""
    rows = views.bank_lines(spark, sf_dir)
    label = F.concat(F.lit("CARTE "), F.date_format(F.date_sub("day", (F.col("line_id") % 5).cast("int")), "dd/MM"), F.lit(" SHOP"))
    return rows.select("line_id", parse.card_date(label, F.col("day")).alias("card_day"), "day")


@query(f"""
WITH {RECIPES}, s AS (SELECT recipe_id, sold FROM sold), o AS (SELECT i.recipe_id, i.product_id, amount, sold, count(*) OVER (PARTITION BY i.recipe_id, grp) AS n FROM ingredients i JOIN s USING (recipe_id))
SELECT product_id, CAST(sum(CASE WHEN n = 1 THEN amount * sold ELSE 0 END) AS DOUBLE) AS certain, CAST(sum(CASE WHEN n > 1 THEN amount * sold ELSE 0 END) AS DOUBLE) AS possible, count(DISTINCT recipe_id) AS n_recipes FROM o GROUP BY 1
""")
def sold_terms(spark, sf_dir):
    """What sales took of each product for sure, and could have taken of it where there was a choice."""
    rows = src.ingredients(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("recipe_id", "grp"))).join(_sold(spark, sf_dir), "recipe_id")
    took = F.col("amount") * F.col("sold")
    return rows.groupBy("product_id").agg(F.sum(F.when(F.col("n") == 1, took).otherwise(0)).cast(D).alias("certain"), F.sum(F.when(F.col("n") > 1, took).otherwise(0)).cast(D).alias("possible"), F.count_distinct("recipe_id").alias("n_recipes"))
