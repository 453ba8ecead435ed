"""Queries over derived data: states, checks, rules, suggestions, usage, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import bank, upkeep
from ledgerloom.operators import stock as stock_ops
from ledgerloom.operators.invoices import payment_state
from ledgerloom.sources import recipes as src
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query
from .till import RECIPES, STOCK, _sold, _stock

D = "double"


@query("""
WITH c AS (SELECT payee_id AS key, sum(amount) AS credit FROM bank_lines WHERE amount > 0 GROUP BY 1), d AS (SELECT payee_id AS key, line_id AS doc_id, -amount AS due, sum(-amount) OVER (PARTITION BY payee_id ORDER BY day, line_id) AS hi FROM bank_lines WHERE amount < 0),
p AS (SELECT doc_id, due, greatest(least(coalesce(credit, 0), hi) - (hi - due), 0) AS paid FROM d LEFT JOIN c USING (key))
SELECT doc_id, CAST(due AS DOUBLE) AS due, CAST(paid AS DOUBLE) AS paid, CASE WHEN paid <= 0 THEN 'unpaid' WHEN paid < due THEN 'partly' WHEN paid = due THEN 'paid' ELSE 'over' END AS state FROM p
""")
def payment_states(spark, sf_dir):
    """What each document has been paid once its payee's credits are laid over its documents in order."""
    rows = views.bank_lines(spark, sf_dir).withColumnsRenamed({"payee_id": "key", "line_id": "id"})
    asked = rows.filter("amount < 0").withColumn("due", -F.col("amount"))
    paid = bank.waterfall(rows.filter("amount > 0"), asked).groupBy(F.col("doc_id").alias("id")).agg(F.sum("share").alias("paid"))
    out = asked.join(paid, "id", "left").withColumn("paid", F.coalesce("paid", F.lit(0)))
    return out.select(F.col("id").alias("doc_id"), F.col("due").cast(D).alias("due"), F.col("paid").cast(D).alias("paid"), payment_state(F.col("due"), F.col("paid")).alias("state"))


@query("""
WITH s AS (SELECT invoice_id AS doc, sum(ht) + CASE WHEN invoice_id % 13 = 0 THEN 1 ELSE 0 END AS ht, round(sum(ht * vat), 2) + CASE WHEN invoice_id % 11 = 0 THEN 1 ELSE 0 END AS tva, sum(ht) + round(sum(ht * vat), 2) AS ttc FROM lines GROUP BY 1),
r AS (SELECT invoice_id AS doc, vat, sum(ht) AS base FROM lines GROUP BY 1, 2), p AS (SELECT doc, sum(base) AS base, sum(round(base * vat, 2)) AS tax FROM r GROUP BY 1)
SELECT doc, abs(base - ht) <= 0.05 AS lines_ok, abs(tax - tva) <= 0.05 AS vat_ok, abs(ht + tva - ttc) <= 0.05 AS total_ok FROM p JOIN s USING (doc)
""")
def document_checks(spark, sf_dir):
    rows = views.lines(spark, sf_dir).withColumnRenamed("invoice_id", "doc")
    off = lambda n: F.when(F.col("doc") % n == 0, F.lit(1)).otherwise(0)
    s = rows.groupBy("doc").agg(F.sum("ht").alias("h"), F.round(F.sum(F.col("ht") * F.col("vat")), 2).alias("v"))
    stated = s.select("doc", (F.col("h") + off(13)).alias("ht"), (F.col("v") + off(11)).alias("tva"), (F.col("h") + F.col("v")).alias("ttc"))
    return upkeep.document_checks(rows, stated)


@query("""
WITH a AS (SELECT CASE WHEN article IN ('Brand#3', 'Brand#4') THEN 'Brand#1' WHEN article = 'Brand#9' THEN 'Brand#2' ELSE article END AS article, quantity, stock_equivalent, ht FROM movements JOIN products USING (product_id))
SELECT article, CAST(sum(quantity * stock_equivalent) AS DOUBLE) AS quantity, CAST(sum(ht) AS DOUBLE) AS value_ht FROM a GROUP BY 1
""")
def merged_articles(spark, sf_dir):
    """Balances after some articles were merged into others: the ledger stays, the key moves."""
    per = stock_ops.ledger_totals(views.movements(spark, sf_dir), views.products(spark, sf_dir), "article")
    merges = views.products(spark, sf_dir).select("article").distinct().filter("article in ('Brand#3', 'Brand#4', 'Brand#9')").select(F.col("article").alias("source"), F.when(F.col("article") == "Brand#9", "Brand#2").otherwise("Brand#1").alias("target"))
    out = upkeep.remapped(per, merges, "article").groupBy("article").agg(F.sum("quantity").cast(D).alias("quantity"), F.sum("value_ht").cast(D).alias("value_ht"))
    return out


RULES = (("bolt|nut|screw", "fixings"), ("ring|gear", "round"), ("red|blue", "coloured"))
CASES = " ".join(f"WHEN regexp_matches(lower(raw_name), '{p}') THEN '{k}'" for p, k in RULES)


@query("WITH h AS (SELECT product_id, raw_name, CASE " + CASES + " END AS kind, " + " + ".join(f"CAST(regexp_matches(lower(raw_name), '{p}') AS INTEGER)" for p, _ in RULES) + " AS n FROM products) SELECT kind, n > 1 AS ambiguous, count(*) AS n_products FROM h GROUP BY 1, 2")
def designation_rules(spark, sf_dir):
    """Kinds of products by ordered patterns, and whether another pattern would have fitted too."""
    found = upkeep.first_rule(F.lower("raw_name"), RULES)
    rows = views.products(spark, sf_dir).select(found.alias("f")).select("f.kind", (F.col("f.n") > 1).alias("ambiguous"))
    return rows.groupBy("kind", "ambiguous").agg(F.count("*").alias("n_products"))


@query(f"""
WITH q AS (SELECT product_id, raw_name, CASE WHEN product_id % 4 <> 0 THEN category END AS category, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(raw_name), '[A-Z]{{3,}}'))), ' ') AS key FROM products), k AS (SELECT key, min(category) AS a, max(category) AS b FROM q WHERE category IS NOT NULL GROUP BY 1),
u AS (SELECT product_id, raw_name, a, b, CASE {CASES} END AS rule FROM q LEFT JOIN k USING (key) WHERE category IS NULL)
SELECT product_id, CASE WHEN a = b THEN a ELSE coalesce(rule, raw_name) END AS suggestion, CASE WHEN a = b THEN 'neighbour' WHEN rule IS NOT NULL THEN 'rule' ELSE 'name' END AS confidence FROM u
""")
def article_suggestions(spark, sf_dir):
    rows = views.products(spark, sf_dir).withColumn("category", F.when(F.col("product_id") % 4 != 0, F.col("category")))
    return upkeep.suggestions(rows, RULES)


@query(f"""
WITH {RECIPES}, reach(a, b, share) AS (SELECT recipe_id, recipe_id, CAST(1 AS DOUBLE) FROM recipes UNION ALL SELECT r.a, s.sub_recipe, r.share * 0.5 FROM reach r JOIN recipes s ON s.recipe_id = r.b WHERE s.sub_recipe IS NOT NULL),
t AS (SELECT recipe_id AS b, product_id, CASE WHEN count(*) OVER (PARTITION BY recipe_id, grp) = 1 THEN CAST(amount AS DOUBLE) ELSE 0 END AS low, CAST(amount AS DOUBLE) AS high FROM ingredients)
SELECT a AS recipe_id, product_id, round(sum(low * share), 8) AS low, round(sum(high * share), 8) AS high FROM reach JOIN t USING (b) GROUP BY 1, 2
""")
def usage_terms(spark, sf_dir):
    """What one recipe can use of each product, half a sub-recipe at a time."""
    recipes = src.recipes(spark, sf_dir)
    below = upkeep.shares_below(recipes.filter("sub_recipe is not null").select(F.col("recipe_id").alias("a"), F.col("sub_recipe").alias("b")), 0.5)
    out = upkeep.usage_terms(src.ingredients(spark, sf_dir), recipes, below)
    return out.select("recipe_id", "product_id", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query("""
WITH w AS (SELECT product_id, day, sum(quantity) AS weight FROM lines WHERE flag = 'N' GROUP BY 1, 2), t AS (SELECT product_id, sum(quantity) AS total FROM lines WHERE flag = 'A' GROUP BY 1)
SELECT product_id, day, round(CAST(total AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY product_id) AS DOUBLE), 6) AS amount FROM w JOIN t USING (product_id)
""")
def daily_consumption(spark, sf_dir):
    """What was attributed to each product, over the days that sold it."""
    rows = views.lines(spark, sf_dir)
    weights = rows.filter("flag = 'N'").groupBy("product_id", "day").agg(F.sum("quantity").alias("weight"))
    totals = rows.filter("flag = 'A'").groupBy("product_id").agg(F.sum("quantity").alias("total"))
    return upkeep.spread_over_days(totals, weights, "product_id").withColumn("amount", F.round("amount", 6))


@query(f"""
WITH {RECIPES}, {STOCK}, u AS (SELECT product_id, sum(amount * sold) AS used FROM ingredients JOIN sold USING (recipe_id) GROUP BY 1), g AS (SELECT product_id, opening + purchases - closing - losses AS gone, coalesce(used, 0) AS used FROM stock LEFT JOIN u USING (product_id))
SELECT product_id, CAST(gone AS DOUBLE) AS gone, CAST(used AS DOUBLE) AS could_explain, CAST(gone - used AS DOUBLE) AS gap, CAST(greatest(gone - used, 0) AS DOUBLE) AS room, CASE WHEN gone - used > 0 THEN 'short' WHEN gone - used < 0 THEN 'over' ELSE 'even' END AS status FROM g
""")
def gap_report(spark, sf_dir):
    """Since the count: what left each product's shelf, what sales could explain, and what room that leaves."""
    stock = _stock(spark, sf_dir)
    used = src.ingredients(spark, sf_dir).join(_sold(spark, sf_dir), "recipe_id").groupBy("product_id").agg(F.sum(F.col("amount") * F.col("sold")).alias("used"))
    gone = F.col("opening") + F.col("purchases") - F.col("closing") - F.col("losses")
    rows = stock.join(used, "product_id", "left").select("product_id", gone.alias("gone"), F.coalesce("used", F.lit(0)).alias("used")).withColumn("gap", F.col("gone") - F.col("used"))
    status = F.when(F.col("gap") > 0, "short").when(F.col("gap") < 0, "over").otherwise("even")
    return rows.select("product_id", F.col("gone").cast(D).alias("gone"), F.col("used").cast(D).alias("could_explain"), F.col("gap").cast(D).alias("gap"), F.greatest("gap", F.lit(0)).cast(D).alias("room"), status.alias("status"))


@query("""
WITH w AS (SELECT doc_id, upper(text) AS t FROM documents), k(code, name) AS (VALUES ('SECRET', 'secret'), ('TOKEN', 'token'), ('PASSWORD', 'password'), ('LICENSE', 'license')) SELECT name, count(*) AS n_docs, min(doc_id) AS first_id FROM w JOIN k ON contains(t, code) GROUP BY 1
""")
def identified_by_words(spark, sf_dir):
    """Documents that print one of a few identifying words."""
    words = ("secret", "token", "password", "license")
    up = F.upper("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(F.array(*(F.when(up.contains(w.upper()), F.lit(w)) for w in words)))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"))


@query("""
WITH s AS (SELECT invoice_id, bool_or(product_id % 9 = 0) AS waits, count(*) AS n, sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS returned FROM lines GROUP BY 1)
SELECT CASE WHEN waits THEN 'to_classify' WHEN returned = n THEN 'returned' ELSE 'done' END AS status, count(*) AS n_invoices, CAST(sum(n) AS BIGINT) AS n_lines FROM s GROUP BY 1
""")
def invoice_statuses(spark, sf_dir):
    s = views.lines(spark, sf_dir).groupBy("invoice_id").agg(F.bool_or(F.col("product_id") % 9 == 0).alias("waits"), F.count("*").alias("n"), F.count_if(F.col("flag") == "R").alias("returned"))
    status = F.when(F.col("waits"), "to_classify").when(F.col("returned") == F.col("n"), "returned").otherwise("done")
    return s.groupBy(status.alias("status")).agg(F.count("*").alias("n_invoices"), F.sum("n").alias("n_lines"))
