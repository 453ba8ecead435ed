"""Queries over the till, recipes and margins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerloom.operators import graph, recipes as ops
from ledgerloom.operators.upkeep import shares_below
from ledgerloom.sources import recipes as src
from ledgerloom.sources import views
from ledgerloom.sources.scratch import written
from ledgerloom.sources.tables import table

from .registry import query

D = "double"

SALES = """
sales AS (SELECT event_type AS category, CASE WHEN user_id % 7 = 0 THEN 'none' ELSE 'T' || (user_id % 3) END AS typology, CAST(value AS DECIMAL(12,2)) AS value, user_id % 11 <> 0 AS read, user_id % 4 <> 0 AS costed FROM events)
"""


def _sales(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.when(u % 7 == 0, "none").otherwise(F.concat(F.lit("T"), u % 3)).alias("typology"), F.col("value").cast("decimal(12,2)").alias("value"), (u % 11 != 0).alias("read"), (u % 4 != 0).alias("costed"))


@query(f"""
WITH {SALES}
SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(typology) = 0 THEN 'typology' ELSE 'all' END AS dimension, coalesce(category, typology, 'all') AS label, count(*) AS units,
  count(*) FILTER (WHERE costed) AS costed_units, CAST(coalesce(sum(value) FILTER (WHERE read), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(value) FILTER (WHERE read AND NOT costed), 0) AS DOUBLE) AS uncosted
FROM sales GROUP BY GROUPING SETS ((category), (typology), ())
""")
def till_slices(spark, sf_dir):
    """Both dimensions in one scan: sums by both first, then grouping sets over those few rows."""
    read = F.when(F.col("read"), F.col("value")).otherwise(0)
    both = _sales(spark, sf_dir).groupBy("category", "typology").agg(F.count("*").alias("units"), F.count_if("costed").alias("costed_units"), F.sum(read).alias("revenue"), F.sum(F.when(F.col("costed"), 0).otherwise(read)).alias("uncosted"))
    out = both.groupingSets([["category"], ["typology"], []], "category", "typology").agg(F.grouping("category").alias("g"), F.grouping("typology").alias("h"), *(F.sum(c).alias(c) for c in ("units", "costed_units", "revenue", "uncosted")))
    dimension = F.when(F.col("g") == 0, "category").when(F.col("h") == 0, "typology").otherwise("all")
    return out.select(dimension.alias("dimension"), F.coalesce("category", "typology", F.lit("all")).alias("label"), "units", "costed_units", F.col("revenue").cast(D).alias("revenue"), F.col("uncosted").cast(D).alias("uncosted"))


@query(f"""
WITH {SALES}
SELECT category, CAST(count(*) FILTER (WHERE costed) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) * 100 AS unit_coverage,
  CAST(sum(CASE WHEN read AND costed THEN value ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN read THEN value ELSE 0 END) AS DOUBLE), 0) * 100 AS revenue_coverage FROM sales GROUP BY category
""")
def till_coverage(spark, sf_dir):
    rows = _sales(spark, sf_dir)
    sums = rows.groupBy("category").agg(F.count_if("costed").alias("c"), F.count("*").alias("n"), F.sum(F.when(F.col("read") & F.col("costed"), F.col("value")).otherwise(0)).alias("r"), F.sum(F.when(F.col("read"), F.col("value")).otherwise(0)).alias("t"))
    return sums.select("category", (F.try_divide(F.col("c").cast(D), F.col("n").cast(D)) * 100).alias("unit_coverage"), (F.try_divide(F.col("r").cast(D), F.col("t").cast(D)) * 100).alias("revenue_coverage"))


RECIPES = """
recipes AS (SELECT p_partkey AS recipe_id, CAST(p_retailprice AS DECIMAL(12,2)) AS price_ttc, CASE WHEN p_partkey // 20 * 10 > 0 AND p_partkey // 20 * 10 <> p_partkey THEN p_partkey // 20 * 10 END AS sub_recipe FROM part WHERE p_partkey % 10 = 0),
ing0 AS (SELECT recipe_id, g.grp AS grp, k.k AS k FROM recipes, (SELECT unnest([1, 2, 3]) AS grp) g, (SELECT unnest([0, 1, 2]) AS k) k WHERE k.k <= (recipe_id // 10) % 3),
ingredients AS (SELECT recipe_id, grp, CASE WHEN grp = 3 AND k = 2 AND (recipe_id // 10) % 4 = 0 THEN recipe_id + 13 ELSE recipe_id + grp * 3 + k END AS product_id, CAST((1 + (recipe_id + grp + k) % 4) / 10.0 AS DECIMAL(6,2)) AS amount FROM ing0),
unit_costs AS (SELECT product_id, CAST(sum(ht) AS DOUBLE) / nullif(CAST(sum(quantity) AS DOUBLE), 0) AS unit_cost FROM lines WHERE flag <> 'R' GROUP BY 1),
sold AS (SELECT product_id AS recipe_id, CAST(sum(quantity) AS BIGINT) AS sold FROM lines WHERE product_id % 10 = 0 AND flag = 'N' GROUP BY 1)
"""


#: What each recipe has of those below it: half of one at every level.
BELOW = """
below0(a, b, share) AS (SELECT recipe_id, sub_recipe, CAST(0.5 AS DOUBLE) FROM recipes WHERE sub_recipe IS NOT NULL UNION ALL SELECT x.a, s.sub_recipe, x.share * 0.5 FROM below0 x JOIN recipes s ON s.recipe_id = x.b WHERE s.sub_recipe IS NOT NULL),
below AS (SELECT a, b, sum(share) AS share FROM below0 GROUP BY 1, 2)
"""


def _below(spark, sf_dir):
    return shares_below(src.recipes(spark, sf_dir).filter("sub_recipe is not null").select(F.col("recipe_id").alias("a"), F.col("sub_recipe").alias("b")), 0.5)


def _unit_costs(spark, sf_dir):
    return views.lines(spark, sf_dir).filter("flag <> 'R'").groupBy("product_id").agg(F.try_divide(F.sum("ht").cast(D), F.sum("quantity").cast(D)).alias("unit_cost"))


def _sold(spark, sf_dir):
    return views.lines(spark, sf_dir).filter("product_id % 10 = 0 and flag = 'N'").groupBy(F.col("product_id").alias("recipe_id")).agg(F.sum("quantity").cast("long").alias("sold"))


@query(f"""
WITH {RECIPES},
options AS (SELECT *, CAST(amount AS DOUBLE) * coalesce(unit_cost, 0) AS cost FROM ingredients LEFT JOIN unit_costs USING (product_id)),
groups AS (SELECT recipe_id, grp, min(cost) AS low, max(cost) AS high, min(cost) FILTER (WHERE cost > 0) AS positive FROM options GROUP BY 1, 2),
own AS (SELECT recipe_id, sum(low) AS low, sum(high) AS high, min(positive - low) AS more FROM groups GROUP BY 1), {BELOW}, sub AS (SELECT a AS recipe_id, sum(low * share) AS low, sum(high * share) AS high FROM below JOIN own ON b = recipe_id GROUP BY 1),
per AS (SELECT o.recipe_id, o.low + coalesce(s.low, 0) AS low, o.high + coalesce(s.high, 0) AS high, least(o.more, CASE WHEN s.low <= 0 AND s.high > 0 THEN s.high END) AS more FROM own o LEFT JOIN sub s USING (recipe_id))
SELECT recipe_id, round(low / 2, 6) AS cost_low, round(high / 2, 6) AS cost_high, round(price_ttc / 1.2 - high / 2, 4) AS margin_low, round(price_ttc / 1.2 - low / 2, 4) AS margin_high,
  round((price_ttc / 1.2 - high / 2) / (price_ttc / 1.2) * 100, 4) AS percent_low, round(price_ttc / 1.2 / nullif(CASE WHEN low > 0 THEN low ELSE low + more END / 2, 0), 4) AS factor_high FROM per JOIN recipes USING (recipe_id)
""")
def recipe_cost_bounds(spark, sf_dir):
    """What a sale of each recipe costs, its sub-recipes included."""
    out = ops.price_metrics(src.recipes(spark, sf_dir), ops.cost_bounds(src.ingredients(spark, sf_dir), _unit_costs(spark, sf_dir), _below(spark, sf_dir)))
    return out.select("recipe_id", F.round("cost_low", 6).alias("cost_low"), F.round("cost_high", 6).alias("cost_high"), *(F.round(c, 4).alias(c) for c in ("margin_low", "margin_high", "percent_low", "factor_high")))


@query(f"""
WITH {RECIPES}, n AS (SELECT recipe_id, grp, count(*) AS n FROM ingredients GROUP BY 1, 2), own AS (SELECT recipe_id, sum(ln(n)) AS ways, count(*) AS n_groups FROM n GROUP BY 1), {BELOW}, sub AS (SELECT a AS recipe_id, sum(ways) AS ways, count(*) AS n_below FROM below JOIN own ON b = recipe_id GROUP BY 1)
SELECT recipe_id, round((o.ways + coalesce(s.ways, 0)) / ln(10), 6) AS digits, CASE WHEN o.ways + coalesce(s.ways, 0) < 30 THEN CAST(round(exp(o.ways + coalesce(s.ways, 0))) AS BIGINT) END AS n_variations, n_groups, coalesce(n_below, 0) AS n_below FROM own o LEFT JOIN sub s USING (recipe_id)
""")
def recipe_variation_count(spark, sf_dir):
    """In how many ways a recipe can be made, those of the recipes below it included; in decimal digits, and as a number where
    it has few."""
    n = src.ingredients(spark, sf_dir).groupBy("recipe_id", "grp").agg(F.count("*").alias("n"))
    own = n.groupBy("recipe_id").agg(F.sum(F.ln("n")).alias("ways"), F.count("*").alias("n_groups"))
    sub = _below(spark, sf_dir).join(own.select(F.col("recipe_id").alias("b"), F.col("ways").alias("w")), "b").groupBy(F.col("a").alias("recipe_id")).agg(F.sum("w").alias("w"), F.count("*").alias("n_below"))
    ways = F.col("ways") + F.coalesce("w", F.lit(0.0))
    rows = own.join(sub, "recipe_id", "left")
    return rows.select("recipe_id", F.round(ways / math.log(10), 6).alias("digits"), F.when(ways < 30, F.round(F.exp(ways)).cast("long")).alias("n_variations"), "n_groups", F.coalesce("n_below", F.lit(0)).cast("long").alias("n_below"))


@query(f"""
WITH {RECIPES}, reach(recipe_id, node) AS (SELECT recipe_id, recipe_id FROM recipes UNION SELECT r.recipe_id, s.sub_recipe FROM reach r JOIN recipes s ON s.recipe_id = r.node WHERE s.sub_recipe IS NOT NULL)
SELECT r.recipe_id, count(DISTINCT i.product_id) AS n_products, min(i.product_id) AS first_product, count(DISTINCT r.node) AS n_recipes FROM reach r JOIN ingredients i ON i.recipe_id = r.node GROUP BY 1
""")
def recipe_reach(spark, sf_dir):
    """The products that a recipe can use, through sub-recipes of any depth."""
    own = src.recipes(spark, sf_dir)
    below = graph.reach(own.filter("sub_recipe is not null").select(F.col("recipe_id").alias("a"), F.col("sub_recipe").alias("b")))
    pairs = below.unionByName(own.select(F.col("recipe_id").alias("a"), F.col("recipe_id").alias("b")))
    met = pairs.join(src.ingredients(spark, sf_dir).select(F.col("recipe_id").alias("b"), "product_id").hint("merge"), "b")
    return met.groupBy(F.col("a").alias("recipe_id")).agg(F.count_distinct("product_id").alias("n_products"), F.min("product_id").alias("first_product"), F.count_distinct("b").alias("n_recipes"))


STOCK = """
stock AS (SELECT product_id, CAST(sum(CASE WHEN day <= DATE '1998-01-01' THEN quantity ELSE 0 END) AS DECIMAL(18,3)) AS opening, sum(CASE WHEN day > DATE '1998-01-01' AND day <= DATE '1999-01-01' AND kind = 'PURCHASE' THEN quantity ELSE 0 END) AS purchases,
  sum(CASE WHEN day > DATE '1998-01-01' AND day <= DATE '1999-01-01' AND kind = 'LOSS' THEN -quantity ELSE 0 END) AS losses, CAST(sum(CASE WHEN day <= DATE '1999-01-01' THEN quantity ELSE 0 END) * 0.4 AS DECIMAL(18,3)) AS closing
  FROM movements GROUP BY 1)
"""


def _stock(spark, sf_dir):
    q, d = F.col("quantity"), F.col("day")
    inside = (d > F.lit("1998-01-01").cast("date")) & (d <= F.lit("1999-01-01").cast("date"))
    rows = views.movements(spark, sf_dir).groupBy("product_id").agg(
        F.sum(F.when(d <= F.lit("1998-01-01").cast("date"), q).otherwise(0)).cast("decimal(18,3)").alias("opening"), F.sum(F.when(inside & (F.col("kind") == "PURCHASE"), q).otherwise(0)).alias("purchases"),
        F.sum(F.when(inside & (F.col("kind") == "LOSS"), -q).otherwise(0)).alias("losses"), (F.sum(F.when(d <= F.lit("1999-01-01").cast("date"), q).otherwise(0)) * F.lit("0.4").cast("decimal(2,1)")).cast("decimal(18,3)").alias("closing"),
    )
    return rows.join(views.products(spark, sf_dir).select("product_id", "loss_percent").hint("merge"), "product_id")


#: Pools with what their recipes should have used and what left the shelf.
POOLED = f"""
multi AS (SELECT recipe_id, grp, min(product_id) AS b FROM ingredients GROUP BY 1, 2 HAVING count(*) > 1),
{BELOW}, size AS (SELECT recipe_id, grp, count(*) AS n FROM ingredients GROUP BY 1, 2), under AS (SELECT a AS top, product_id, n FROM below JOIN ingredients i ON i.recipe_id = b JOIN size z ON z.recipe_id = b AND z.grp = i.grp), tops AS (SELECT top, min(product_id) AS b FROM under GROUP BY 1 HAVING max(n) > 1),
edges AS (SELECT i.product_id AS a, m.b AS b FROM ingredients i JOIN multi m USING (recipe_id, grp) UNION SELECT product_id, t.b FROM under JOIN tops t USING (top)), sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
conn(node, other) AS (SELECT a, a FROM sym UNION SELECT c.node, s.b FROM conn c JOIN sym s ON s.a = c.other),
pools AS (SELECT p.product_id, coalesce(min(c.other), p.product_id) AS pool FROM (SELECT DISTINCT product_id FROM ingredients) p LEFT JOIN conn c ON c.node = p.product_id GROUP BY p.product_id),
terms AS (SELECT i.recipe_id, i.grp, min(amount) AS lo, max(amount) AS hi, min(pool) AS pool FROM ingredients i JOIN pools USING (product_id) GROUP BY 1, 2),
made AS (SELECT recipe_id, sum(sold) AS made FROM (SELECT recipe_id, CAST(sold AS DOUBLE) AS sold FROM sold UNION ALL SELECT b, sold * share FROM below JOIN sold ON a = recipe_id) GROUP BY 1),
use AS (SELECT pool, sum(CAST(lo AS DOUBLE) * made) AS emin, sum(CAST(hi AS DOUBLE) * made) AS emax FROM terms JOIN made USING (recipe_id) GROUP BY 1),
per AS (SELECT pool, count(*) AS n, sum(opening + purchases - closing) AS actual, sum(losses) AS losses, sum(CAST(greatest(opening + purchases - closing, 0) AS DOUBLE) * least(greatest(loss_percent, 0), 100) / 100) AS allowance FROM stock JOIN pools USING (product_id) JOIN products USING (product_id) GROUP BY 1)
"""


@query(f"""
WITH {RECIPES}, {STOCK}, {POOLED},
x AS (SELECT *, coalesce(emin, 0) AS e0, coalesce(emax, 0) AS e1 FROM per LEFT JOIN use USING (pool))
SELECT pool, n AS n_members, CAST(actual AS DOUBLE) AS actual, CAST(losses AS DOUBLE) AS losses, round(e0, 6) AS expected_min, round(e1, 6) AS expected_max, round(actual - losses - e1, 6) AS unexplained_min, round(actual - losses - e0, 6) AS unexplained_max,
  actual - losses - e0 < 0 AS impossible, round(CASE WHEN actual - losses - e0 < 0 THEN 0 ELSE greatest(0, CAST(actual - losses - e1 AS DOUBLE) - allowance) END, 4) AS shortfall FROM x
""")
def variance_by_pool(spark, sf_dir):
    """What left the shelf of each pool against what its recipes, and those below them, should have used."""
    ingredients, below = src.ingredients(spark, sf_dir), written(_below(spark, sf_dir))
    pool_of = written(ops.pools(ingredients, below))
    use = ops.expected_use(ingredients.withColumn("amount", F.col("amount").cast(D)), ops.made(_sold(spark, sf_dir), below), pool_of)
    out = ops.variance(_stock(spark, sf_dir), use, pool_of)
    return out.select("pool", "n_members", *(F.col(c).cast(D).alias(c) for c in ("actual", "losses")), *(F.round(F.col(c).cast(D), 6).alias(c) for c in ("expected_min", "expected_max", "unexplained_min", "unexplained_max")), "impossible", F.round(F.col("shortfall").cast(D), 4).alias("shortfall"))


@query(f"""
WITH {RECIPES}, {STOCK}, {POOLED}, alone AS (SELECT coalesce(pool, l.product_id) AS pool, sum(quantity) AS q FROM lines l LEFT JOIN pools ON pools.product_id = l.product_id WHERE flag = 'R' AND l.product_id % 7 = 3 AND day > DATE '1998-01-01' AND day <= DATE '1999-01-01' GROUP BY 1),
members AS (SELECT pool, product_id, unit_cost, CAST(p_size AS DOUBLE) / 10 AS item_size, product_id % 9 <> 4 AS counted FROM pools LEFT JOIN unit_costs USING (product_id) JOIN part ON p_partkey = product_id),
cheap AS (SELECT pool, unit_cost, item_size FROM members WHERE unit_cost > 0 QUALIFY row_number() OVER (PARTITION BY pool ORDER BY unit_cost, product_id) = 1), sure AS (SELECT pool, bool_and(counted) AS reliable FROM members GROUP BY 1),
x AS (SELECT per.*, coalesce(emin, 0) + coalesce(q, 0) AS e0, coalesce(emax, 0) + coalesce(q, 0) AS e1 FROM per LEFT JOIN use USING (pool) LEFT JOIN alone USING (pool)),
y AS (SELECT *, CASE WHEN actual - losses - e0 < 0 THEN 0 ELSE greatest(0, CAST(actual - losses - e1 AS DOUBLE) - allowance) END AS shortfall FROM x)
SELECT pool, round(e0, 6) AS expected_min, round(e1, 6) AS expected_max, round(shortfall, 4) AS shortfall, round(shortfall * unit_cost, 2) AS value_missing, round(CASE WHEN item_size > 0 THEN shortfall / item_size END, 4) AS items_missing, reliable FROM y LEFT JOIN cheap USING (pool) LEFT JOIN sure USING (pool)
""")
def shrinkage_floors(spark, sf_dir):
    """What is missing from each pool at least, in items and money of its cheapest member, articles sold as themselves counted in."""
    ingredients, below = src.ingredients(spark, sf_dir), written(_below(spark, sf_dir))
    pool_of = written(ops.pools(ingredients, below))
    use = ops.expected_use(ingredients.withColumn("amount", F.col("amount").cast(D)), ops.made(_sold(spark, sf_dir), below), pool_of)
    day = F.col("day")
    alone = views.lines(spark, sf_dir).filter((F.col("flag") == "R") & (F.col("product_id") % 7 == 3) & (day > F.lit("1998-01-01").cast("date")) & (day <= F.lit("1999-01-01").cast("date"))).groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    found = ops.variance(_stock(spark, sf_dir), ops.with_own_sales(use, alone, pool_of), pool_of)
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size").cast(D) / 10).alias("item_size"))
    members = pool_of.join(sizes.hint("merge"), "product_id").join(_unit_costs(spark, sf_dir).hint("merge"), "product_id", "left").withColumn("counted", F.col("product_id") % 9 != 4)
    out = ops.floors(found, members)
    return out.select("pool", *(F.round(F.col(c).cast(D), n).alias(c) for c, n in (("expected_min", 6), ("expected_max", 6), ("shortfall", 4), ("value_missing", 2), ("items_missing", 4))), "reliable")


def _demands(spark, sf_dir):
    ingredients, sold = src.ingredients(spark, sf_dir), _sold(spark, sf_dir)
    below = shares_below(src.recipes(spark, sf_dir).filter("sub_recipe is not null").select(F.col("recipe_id").alias("a"), F.col("sub_recipe").alias("b")), 0.5)
    inside = below.join(sold.withColumnRenamed("recipe_id", "a"), "a").groupBy(F.col("b").alias("recipe_id")).agg(F.sum(F.col("share") * F.col("sold")).alias("sold"))
    stock = _stock(spark, sf_dir).withColumn("available", F.col("opening") + F.col("purchases") - F.col("closing") - F.col("losses")).withColumn("loss", F.col("loss_percent") / 100)
    rows = ingredients.join(ops.pools(ingredients), "product_id").join(sold, "recipe_id").join(stock.select("product_id", "available", "loss"), "product_id", "left").join(_unit_costs(spark, sf_dir), "product_id", "left").join(ops.fixed_use(ingredients, inside), "product_id", "left")
    return rows.select("pool", "recipe_id", "grp", "product_id", "amount", "sold", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("loss", F.lit(0)).alias("loss"), F.coalesce("unit_cost", F.lit(0.0)).alias("cost"), F.coalesce("used", F.lit(0.0)).alias("used"))


@query()
def sold_attribution(spark, sf_dir):
    """Servings of each option of each choice: greedy inside a pool, pools apart, after what groups without a choice took, in
    sub-recipes too."""
    return ops.attribute_choices(_demands(spark, sf_dir))


@query(f"""
WITH {RECIPES}, {SALES},
till AS (SELECT CAST(sum(value) FILTER (WHERE read) AS DOUBLE) AS revenue FROM sales), spend AS (SELECT CAST(sum(ht) AS DOUBLE) AS spend, CAST(sum(CASE WHEN supplier_id % 10 = 0 THEN ht ELSE 0 END) AS DOUBLE) AS left_out FROM lines),
options AS (SELECT *, CAST(amount AS DOUBLE) * coalesce(unit_cost, 0) AS cost FROM ingredients LEFT JOIN unit_costs USING (product_id)),
groups AS (SELECT recipe_id, grp, min(cost) AS low, max(cost) AS high FROM options GROUP BY 1, 2), own AS (SELECT recipe_id, sum(low) AS low, sum(high) AS high FROM groups GROUP BY 1), {BELOW}, sub AS (SELECT a AS recipe_id, sum(low * share) AS low, sum(high * share) AS high FROM below JOIN own ON b = recipe_id GROUP BY 1),
per AS (SELECT o.recipe_id, o.low + coalesce(s.low, 0) AS low, o.high + coalesce(s.high, 0) AS high FROM own o LEFT JOIN sub s USING (recipe_id)), flagged AS (SELECT CAST(sum(ht) AS DOUBLE) AS flagged FROM lines JOIN products USING (product_id) WHERE category = 'C1' AND flag <> 'R'), docs AS (SELECT CAST(sum(amount) AS DOUBLE) AS documents FROM bank_lines WHERE amount > 0 AND line_id % 5 = 0),
cogs AS (SELECT sum(low / 2 * sold) AS low, sum(high / 2 * sold) AS high FROM per JOIN sold USING (recipe_id))
SELECT revenue + documents AS revenue, spend, round(revenue + documents - spend, 2) AS real_margin, round(revenue + documents - (spend - left_out), 2) AS kept_margin, round(revenue + documents - cogs.high - flagged, 1) AS products_low, round(revenue + documents - cogs.low - flagged, 1) AS products_high, (revenue + documents - spend) / nullif(revenue + documents, 0) * 100 AS real_percent FROM till, spend, cogs, docs, flagged
""")
def margins_summary(spark, sf_dir):
    """Three profit figures, each from one-row sums: the till's and counted documents' revenue against all invoices, against those
    that are not left out, and against what recipes cost, sub-recipes included, and flagged purchases."""
    till = _sales(spark, sf_dir).filter("read").agg(F.sum("value").cast(D).alias("till"))
    documents = views.bank_lines(spark, sf_dir).filter("amount > 0 and line_id % 5 = 0").agg(F.sum("amount").cast(D).alias("documents"))
    lines = views.lines(spark, sf_dir)
    spend = lines.agg(F.sum("ht").cast(D).alias("spend"), F.sum(F.when(F.col("supplier_id") % 10 == 0, F.col("ht")).otherwise(0)).cast(D).alias("left_out"))
    flagged = lines.filter("flag <> 'R'").join(views.products(spark, sf_dir).filter("category = 'C1'").select("product_id"), "product_id").agg(F.sum("ht").cast(D).alias("flagged"))
    bounds = ops.cost_bounds(src.ingredients(spark, sf_dir), _unit_costs(spark, sf_dir), _below(spark, sf_dir))
    cogs = bounds.join(_sold(spark, sf_dir), "recipe_id").agg(F.sum(F.col("low") / 2 * F.col("sold")).alias("low"), F.sum(F.col("high") / 2 * F.col("sold")).alias("high"))
    # One row each.
    all_ = till.join(F.broadcast(documents)).join(F.broadcast(spend)).join(F.broadcast(flagged)).join(F.broadcast(cogs)).withColumn("revenue", F.col("till") + F.col("documents"))
    r, s, f = F.col("revenue"), F.col("spend"), F.col("flagged")
    return all_.select(
        "revenue", "spend", F.round(r - s, 2).alias("real_margin"), F.round(r - (s - F.col("left_out")), 2).alias("kept_margin"), F.round(r - F.col("high") - f, 1).alias("products_low"),
        F.round(r - F.col("low") - f, 1).alias("products_high"), (F.try_divide(r - s, r) * 100).alias("real_percent"),
    )
