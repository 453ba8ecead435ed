"""Derived data kept in step: merges of keys, states, checks, ordered rules, suggestions, usage terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import name_words
from ledgerloom.sources.scratch import written


def remapped(facts: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """``facts`` with every ``key`` that was merged (source, target) moved to its target."""
    to = merges.select(F.col("source").alias(key), F.col("target").alias("__to"))
    return facts.join(to, key, "left").withColumn(key, F.coalesce("__to", key)).drop("__to")


def first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(kind, n): the kind of the first rule (pattern, kind) that ``text`` matches, and how many kinds would; more than
    one is ambiguous."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        kind = F.when(text.rlike(pattern), F.lit(name)).otherwise(kind)
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for p, n in rules))))
    return F.struct(kind.alias("kind"), F.size(hits).alias("n"))


def document_checks(lines: DataFrame, stated: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """(doc, lines_ok, vat_ok, total_ok): lines against the document's HT, each rate's VAT against base times rate, and TTC
    against HT and VAT. ``stated``: doc, ht, vat, ttc."""
    rate = lines.groupBy("doc", "vat").agg(F.sum("ht").alias("base")).withColumn("tax", F.round(F.col("base") * F.col("vat"), 2))
    per = rate.groupBy("doc").agg(F.sum("base").alias("base"), F.sum("tax").alias("tax"))
    near = lambda a, b: F.abs(a - b) <= F.lit(tolerance).cast("decimal(6,2)")
    return per.join(stated, "doc").select("doc", near(F.col("base"), F.col("ht")).alias("lines_ok"), near(F.col("tax"), F.col("tva")).alias("vat_ok"), near(F.col("ht") + F.col("tva"), F.col("ttc")).alias("total_ok"))


def suggestions(products: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(product_id, suggestion, confidence) for products without a category (null): that of classified neighbours with the
    same words if they agree, else of the first rule that fits, else the raw name."""
    key = F.array_join(F.array_sort(F.array_distinct(name_words(F.col("raw_name")))), " ")
    rows = products.withColumn("key", key)
    known = rows.filter("category is not null").groupBy("key").agg(F.min("category").alias("a"), F.max("category").alias("b"))
    asked = rows.filter("category is null").join(known, "key", "left").withColumn("rule", first_rule(F.lower("raw_name"), rules)["kind"])
    agreed = F.col("a").isNotNull() & (F.col("a") == F.col("b"))
    return asked.select("product_id", F.when(agreed, F.col("a")).otherwise(F.coalesce("rule", "raw_name")).alias("suggestion"), F.when(agreed, "neighbour").when(F.col("rule").isNotNull(), "rule").otherwise("name").alias("confidence"))


def usage_terms(ingredients: DataFrame, recipes: DataFrame, below: DataFrame) -> DataFrame:
    """(recipe_id, product_id, low, high): the least and the most of each product that one unit of a recipe can use, its
    sub-recipes' use counted through the pairs ``below`` (a, b, share) at each one's share."""
    own = recipes.select(F.col("recipe_id").alias("a"), F.col("recipe_id").alias("b"), F.lit(1.0).alias("share"))
    options = Window.partitionBy("recipe_id", "grp")
    terms = ingredients.withColumn("n", F.count("*").over(options)).select(F.col("recipe_id").alias("b"), "product_id", F.when(F.col("n") == 1, F.col("amount")).otherwise(0).cast("double").alias("low"), F.col("amount").cast("double").alias("high"))
    met = own.unionByName(below.select("a", "b", "share")).join(terms, "b")
    return met.groupBy(F.col("a").alias("recipe_id"), "product_id").agg(F.sum(F.col("low") * F.col("share")).alias("low"), F.sum(F.col("high") * F.col("share")).alias("high"))


def shares_below(edges: DataFrame, share: float, most: int = 64) -> DataFrame:
    """(a, b, share) of every b below a along edges (a, b): a level down multiplies the share, paths to one b add up.

    A path carries the nodes it has been through and ends before it comes to one again: what lies in a circle counts once,
    and the circle itself nothing. Paths longer than ``most`` raise.
    """
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    frontier = written(edges.filter("a != b").select("a", "b", F.lit(share).alias("share"), F.array("a", "b").alias("path")))
    found = frontier.select("a", "b", "share")
    for _ in range(most):
        on = frontier.join(step.hint("merge"), "b").filter(~F.array_contains("path", F.col("c")))
        frontier = written(on.select("a", F.col("c").alias("b"), (F.col("share") * share).alias("share"), F.concat("path", F.array("c")).alias("path")))
        if frontier.isEmpty():
            return found.groupBy("a", "b").agg(F.sum("share").alias("share"))
        found = found.unionByName(frontier.select("a", "b", "share"))
    raise ValueError(f"recipes nested deeper than {most}")


def spread_over_days(totals: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, day, amount): each key's total over its days, in proportion to their weights; divided once, at the end."""
    whole = F.sum("weight").over(Window.partitionBy(key))
    w = weights.withColumn("__all", whole)
    return w.join(totals, key).select(key, "day", F.try_divide(F.col("total").cast("double") * F.col("weight").cast("double"), F.col("__all").cast("double")).alias("amount"))
