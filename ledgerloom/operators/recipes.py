"""Recipes: cost ranges, pools of alternatives, expected use, shrinkage, attribution of what was sold."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import loss_allowance, percent

from ledgerloom.sources.scratch import written
from ledgerloom.sources.ship import ship

from .graph import components


def cost_bounds(ingredients: DataFrame, unit_costs: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(recipe_id, low, high, low_positive, n_variations): cheapest and dearest choice of every group, summed; the smallest
    positive total where some options are free; and in how many ways the groups can be chosen. Linear in the options.

    With the pairs ``below`` (a, b, share) of ``upkeep.shares_below`` a recipe also costs its sub-recipes, as a group with one
    option whose variations are theirs."""
    options = ingredients.join(unit_costs, "product_id", "left").withColumn("cost", F.col("amount").cast("double") * F.coalesce("unit_cost", F.lit(0.0)))
    groups = options.groupBy("recipe_id", "grp").agg(F.min("cost").alias("low"), F.max("cost").alias("high"), F.min(F.when(F.col("cost") > 0, F.col("cost"))).alias("positive"), F.count("*").alias("n"))
    per = groups.groupBy("recipe_id").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.min(F.col("positive") - F.col("low")).alias("least_more"),
        F.aggregate(F.collect_list("n"), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)")).alias("n_variations"),
    )
    if below is not None:
        part = per.select(F.col("recipe_id").alias("b"), "low", "high", "n_variations")
        sums = below.join(part, "b").groupBy(F.col("a").alias("recipe_id")).agg(F.sum(F.col("low") * F.col("share")).alias("sub_low"), F.sum(F.col("high") * F.col("share")).alias("sub_high"), F.collect_list("n_variations").alias("ways"))
        free = F.when((F.col("sub_low") <= 0) & (F.col("sub_high") > 0), F.col("sub_high"))
        per = per.join(sums, "recipe_id", "left").select(
            "recipe_id", (F.col("low") + F.coalesce("sub_low", F.lit(0.0))).alias("low"), (F.col("high") + F.coalesce("sub_high", F.lit(0.0))).alias("high"), F.least("least_more", free).alias("least_more"),
            F.aggregate(F.coalesce("ways", F.array().cast("array<decimal(38,0)>")), F.col("n_variations"), lambda a, x: (a * x).cast("decimal(38,0)")).alias("n_variations"),
        )
    return per.select("recipe_id", "low", "high", F.when(F.col("low") > 0, F.col("low")).otherwise(F.col("low") + F.col("least_more")).alias("low_positive"), "n_variations")


def price_metrics(recipes: DataFrame, bounds: DataFrame, vat: float = 0.2) -> DataFrame:
    """Cost of a sale and its margin, in money and percent, for the dearest and the cheapest variation."""
    per = lambda c: F.try_divide(F.col(c) * F.col("sale_quantity"), F.col("yields"))
    price = F.col("price_ttc").cast("double") / (1 + vat)
    rows = recipes.join(bounds, "recipe_id").withColumn("price_ht", price).withColumn("cost_low", per("low")).withColumn("cost_high", per("high"))
    return rows.withColumn("margin_low", F.col("price_ht") - F.col("cost_high")).withColumn("margin_high", F.col("price_ht") - F.col("cost_low")).withColumn("percent_low", percent(F.col("margin_low"), F.col("price_ht"))).withColumn("factor_high", F.try_divide(F.col("price_ht"), per("low_positive")))


def pools(ingredients: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(product_id, pool): products that can stand for one another, directly or through others, share the smallest id. With
    ``below`` all products under a recipe whose sub-recipes leave a choice do, too."""
    groups = ingredients.groupBy("recipe_id", "grp").agg(F.min("product_id").alias("b"), F.count("*").alias("n"))
    edges = ingredients.join(groups.filter("n > 1").hint("merge"), ["recipe_id", "grp"]).select(F.col("product_id").alias("a"), "b")
    if below is not None:
        under = below.select(F.col("a").alias("top"), F.col("b").alias("recipe_id")).join(ingredients.join(groups.select("recipe_id", "grp", "n").hint("merge"), ["recipe_id", "grp"]).hint("merge"), "recipe_id")
        first = under.groupBy("top").agg(F.min("product_id").alias("b"), F.max("n").alias("most")).filter("most > 1")
        edges = edges.unionByName(under.join(first.hint("merge"), "top").select(F.col("product_id").alias("a"), "b"))
    found = components(edges)
    return ingredients.select("product_id").distinct().join(found.hint("merge"), F.col("product_id") == F.col("node"), "left").select("product_id", F.coalesce("root", "product_id").alias("pool"))


def made(sold: DataFrame, below: DataFrame) -> DataFrame:
    """(recipe_id, sold): how much of each recipe went out, sold or inside those sold above it."""
    inside = below.join(sold.select(F.col("recipe_id").alias("a"), "sold").hint("merge"), "a").select(F.col("b").alias("recipe_id"), (F.col("sold") * F.col("share")).alias("sold"))
    return sold.select("recipe_id", F.col("sold").cast("double").alias("sold")).unionByName(inside).groupBy("recipe_id").agg(F.sum("sold").alias("sold"))


def fixed_use(ingredients: DataFrame, sold: DataFrame) -> DataFrame:
    """(product_id, used): what groups without a choice took for certain."""
    lone = ingredients.groupBy("recipe_id", "grp").agg(F.min("product_id").alias("product_id"), F.min("amount").alias("amount"), F.count("*").alias("n")).filter("n = 1")
    return lone.join(sold, "recipe_id").groupBy("product_id").agg(F.sum(F.col("amount").cast("double") * F.col("sold")).alias("used"))


def expected_use(ingredients: DataFrame, sold: DataFrame, pool_of: DataFrame) -> DataFrame:
    """(pool, expected_min, expected_max): each group of a recipe sold takes between its least and its greatest option.
    Sub-recipes count where ``sold`` is what ``made`` gives."""
    options = ingredients.join(pool_of.hint("merge"), "product_id")
    terms = options.groupBy("recipe_id", "grp").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.min("pool").alias("pool"))
    return terms.join(sold.hint("merge"), "recipe_id").groupBy("pool").agg(F.sum(F.col("lo") * F.col("sold")).alias("expected_min"), F.sum(F.col("hi") * F.col("sold")).alias("expected_max"))


def variance(stock: DataFrame, use: DataFrame, pool_of: DataFrame) -> DataFrame:
    """One row a pool. ``stock``: product_id, opening, purchases, losses, closing, loss_percent.

    What left the shelf less known losses and expected use is unexplained, between two bounds; the shortfall is what of the
    smaller bound each member's own allowance does not cover; a negative larger bound is impossible.
    """
    left = F.col("opening") + F.col("purchases") - F.col("closing")
    rows = stock.join(pool_of.hint("merge"), "product_id").withColumn("left", left).withColumn("allowance", loss_allowance(F.col("left"), F.col("loss_percent")))
    per = rows.groupBy("pool").agg(F.count("*").alias("n_members"), F.sum("left").alias("actual"), F.sum("losses").alias("losses"), F.sum("allowance").alias("allowance"))
    out = per.join(use.hint("merge"), "pool", "left").withColumn("expected_min", F.coalesce("expected_min", F.lit(0))).withColumn("expected_max", F.coalesce("expected_max", F.lit(0)))
    out = out.withColumn("unexplained_min", F.col("actual") - F.col("losses") - F.col("expected_max")).withColumn("unexplained_max", F.col("actual") - F.col("losses") - F.col("expected_min"))
    out = out.withColumn("impossible", F.col("unexplained_max") < 0)
    return out.withColumn("shortfall", F.when(F.col("impossible"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("unexplained_min") - F.col("allowance"))))


def with_own_sales(use: DataFrame, alone: DataFrame, pool_of: DataFrame) -> DataFrame:
    """``use`` of pools with articles sold as themselves: ``alone`` (product_id, quantity) takes exactly that from its pool, or from
    itself where it is in none."""
    own = alone.join(pool_of.hint("merge"), "product_id", "left").select(F.coalesce("pool", "product_id").alias("pool"), F.col("quantity").cast("double").alias("q"))
    both = use.select("pool", F.col("expected_min").cast("double").alias("lo"), F.col("expected_max").cast("double").alias("hi")).unionByName(own.select("pool", F.col("q").alias("lo"), F.col("q").alias("hi")))
    return both.groupBy("pool").agg(F.sum("lo").alias("expected_min"), F.sum("hi").alias("expected_max"))


def floors(pools: DataFrame, members: DataFrame) -> DataFrame:
    """``pools`` (pool, shortfall, ...) with what the shortfall is worth and how many items it is, both at the member that costs
    least, and whether every member was counted. ``members``: pool, product_id, unit_cost, item_size, counted."""
    cost, size = F.col("unit_cost"), F.col("item_size")
    cheapest = F.min_by(F.struct("unit_cost", "item_size"), F.when(cost > 0, F.struct(cost, F.col("product_id"))))
    per = members.groupBy("pool").agg(cheapest.alias("cheapest"), F.bool_and("counted").alias("reliable"))
    rows = pools.join(per.hint("merge"), "pool", "left")
    size = F.col("cheapest.item_size")
    return rows.withColumn("value_missing", F.col("shortfall") * F.col("cheapest.unit_cost")).withColumn("items_missing", F.when(size > 0, F.col("shortfall") / size)).withColumn("reliable", F.coalesce("reliable", F.lit(False))).drop("cheapest")


#: Rows of one group of pools, about.
POOL_ROWS = 50_000


def attribute_choices(demands: DataFrame) -> DataFrame:
    """Which option of each choice was poured: rows (pool, recipe_id, grp, product_id, amount, sold, available, loss, cost) in,
    the same keys and ``servings`` out.

    Certain use comes off the shelf first: ``used`` of each product, if there is such a column, and then groups with a single
    option, which take all that was sold whether it was there or not. In each pool the choices go in order of recipe and group, over their options dearest first: whole servings up to what is
    left after the normal loss, then up to what is left at all, and the rest to the dearest. Pools share no product, so many
    small ones go through one task together, and each stays whole.
    """

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(price=rows.cost * rows.amount).sort_values(["pool", "recipe_id", "grp", "price", "product_id"], ascending=[True, True, True, False, True])
        choice = list(zip(rows.recipe_id, rows.grp, strict=True))
        product, amount, available, loss = (rows[c].tolist() for c in ("product_id", "amount", "available", "loss"))
        due = {c: int(n) for c, n in zip(reversed(choice), reversed(rows.sold.tolist()), strict=True)}
        used: dict[int, float] = dict(zip(product, rows.used.tolist(), strict=True))
        served = [0] * len(rows)
        options = Counter(choice)
        for i, c in enumerate(choice):
            if options[c] == 1:
                served[i], due[c] = due[c], 0
                used[product[i]] += max(amount[i], 0.0) * served[i]
        for within_loss in (True, False):
            for i, c in enumerate(choice):
                if amount[i] <= 0 or due[c] <= 0:
                    continue
                taken = used[product[i]]
                room = available[i] - taken
                fit = math.floor(room / amount[i] + 1e-9) if room > 0 else 0
                if within_loss:
                    after = available[i] * (1 - loss[i]) - taken
                    fit = min(fit, math.ceil(after / amount[i] - 1e-9)) if after > 0 else 0
                n = min(fit, due[c])
                served[i] += n
                due[c] -= n
                used[product[i]] = taken + n * amount[i]
        for i, c in enumerate(choice):
            served[i] += due[c]
            due[c] = 0
        return rows.assign(servings=served)[["pool", "recipe_id", "grp", "product_id", "servings"]]

    ship(demands.sparkSession)
    demands = demands if "used" in demands.columns else demands.withColumn("used", F.lit(0.0))
    flat = written(demands.select("pool", "recipe_id", "grp", "product_id", *(F.col(c).cast("double").alias(c) for c in ("amount", "sold", "available", "loss", "cost", "used"))))
    groups = max(1, math.ceil(flat.count() / POOL_ROWS))
    part = F.pmod(F.xxhash64("pool"), F.lit(groups))
    return flat.withColumn("part", part).groupBy("part").applyInPandas(serve, "pool long, recipe_id long, grp int, product_id long, servings long")
