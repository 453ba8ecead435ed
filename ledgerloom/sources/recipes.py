"""Recipes, derived from products: every tenth is one, with three groups of interchangeable products near it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, name, price_ttc, sub_recipe (null for the first ones), yields, sale_quantity."""
    rows = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0")
    sub = (F.floor(F.col("p_partkey") / 20) * 10).cast("long")
    return rows.select(
        F.col("p_partkey").alias("recipe_id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("decimal(12,2)").alias("price_ttc"),
        F.when((sub > 0) & (sub != F.col("p_partkey")), sub).alias("sub_recipe"), F.lit(2).alias("yields"), F.lit(1).alias("sale_quantity"),
    )


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, grp, product_id, amount: options of a group are alternatives. Some recipes share one with the next."""
    rows = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("recipe_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("grp"))
    rows = rows.select("recipe_id", "grp", F.explode(F.sequence(F.lit(0), (F.col("recipe_id") / 10).cast("int") % 3)).alias("k"))
    product = F.when((F.col("grp") == 3) & (F.col("k") == 2) & ((F.col("recipe_id") / 10).cast("int") % 4 == 0), F.col("recipe_id") + 13).otherwise(F.col("recipe_id") + F.col("grp") * 3 + F.col("k"))
    return rows.select("recipe_id", "grp", product.alias("product_id"), ((1 + (F.col("recipe_id") + F.col("grp") + F.col("k")) % 4) / F.lit(10)).cast("decimal(6,2)").alias("amount"))
