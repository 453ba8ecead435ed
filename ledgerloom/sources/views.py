"""The domain's tables, seen in the star schema: purchases, till, bank, products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, raw_name, article (its brand), category, loss_percent, stock_equivalent."""
    n = F.substring("p_brand", 7, 10).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("raw_name"), F.col("p_brand").alias("article"), F.concat(F.lit("C"), n % 5).alias("category"),
        (5 + n % 20).alias("loss_percent"), (F.col("p_size").cast("decimal(5,1)") / 10).cast("decimal(6,1)").alias("stock_equivalent"), F.col("p_type").alias("type"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines: invoice_id, line, product_id, supplier_id, day, quantity, ht, vat, discount, flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").cast("decimal(12,3)").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("ht"), F.col("l_tax").cast("decimal(4,2)").alias("vat"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"), F.col("l_returnflag").alias("flag"),
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as ledger movements: kind, and quantity and ht signed (returns and losses leave)."""
    loss = (F.col("flag") == "A") & (F.col("line") == 7)
    sign = F.when(loss | (F.col("flag") == "R"), F.lit(-1)).otherwise(F.lit(1))
    rows = lines(spark, sf_dir).withColumn("kind", F.when(loss, "LOSS").otherwise("PURCHASE"))
    return rows.withColumn("quantity", (sign * F.col("quantity")).cast("decimal(12,3)")).withColumn("ht", (sign * F.col("ht")).cast("decimal(12,2)"))


def till_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, day, quantity, revenue of the till."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("product"), F.to_date("ts").alias("day"), F.col("value").cast("decimal(12,2)").alias("value"))
    return rows.groupBy("product", "day").agg(F.count("*").alias("quantity"), F.sum("value").alias("revenue"))


def till_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, method, amount of the till's payments."""
    methods = F.array(*map(F.lit, ("card", "cash", "cheque", "voucher", "transfer")))
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.element_at(methods, (F.col("user_id") % 5 + 1).cast("int")).alias("method"), F.col("value").cast("decimal(12,2)").alias("value"))
    return rows.groupBy("day", "method").agg(F.sum("value").alias("amount"))


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, day, amount (credits of finished orders, else debits), payee_id, account."""
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", amount).otherwise(-amount).cast("decimal(12,2)").alias("amount"),
        F.col("o_custkey").alias("payee_id"), F.col("o_orderpriority").alias("account"),
    )
