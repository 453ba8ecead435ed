"""Amounts spread over parts so that they add back to the cent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import truncated


def largest_remainder(rows: DataFrame, doc: str, position: str, amount: str, weight: str, out: str = "share") -> DataFrame:
    """Spread ``amount`` (one a document) over lines with a positive ``weight``: shares are cut toward zero, and the cents
    left go one each to the largest remainders, the earliest line first. Other lines get 0; with no weight all do.

    A negative amount is spread as its absolute value and turned: since all weights are positive that is the signed leftover, in
    order of absolute remainders, of a delivery charge that was credited."""
    whole = Window.partitionBy(doc)
    w = F.greatest(F.col(weight), F.lit(0)).cast("decimal(14,2)")
    rows = rows.withColumn("__w", w).withColumn("__sum", F.sum("__w").over(whole).cast("decimal(16,2)"))
    exact = F.try_divide((F.abs(F.col(amount)).cast("decimal(12,2)") * F.col("__w")).cast("decimal(28,4)"), F.col("__sum"))
    rows = rows.withColumn("__exact", F.coalesce(exact, F.lit(0)).cast("decimal(28,10)")).withColumn("__cut", truncated(F.col("__exact")))
    left = F.round((F.abs(F.col(amount)) - F.sum("__cut").over(whole)) * 100).cast("int")
    order = Window.partitionBy(doc).orderBy((F.col("__w") > 0).desc(), (F.col("__exact") - F.col("__cut")).desc(), F.col(position))
    rows = rows.withColumn("__left", left).withColumn("__rank", F.row_number().over(order))
    cent = F.when((F.col("__w") > 0) & (F.col("__rank") <= F.col("__left")), F.lit("0.01")).otherwise(F.lit("0.00")).cast("decimal(12,2)")
    share = (F.col("__cut") + cent).cast("decimal(12,2)")
    return rows.withColumn(out, F.when(F.col(amount) < 0, -share).otherwise(share).cast("decimal(12,2)")).drop("__w", "__sum", "__exact", "__cut", "__left", "__rank")


def promotion(rows: DataFrame, doc: str, position: str, discount: str, weight: str, out: str = "share") -> DataFrame:
    """The same of a ticket's promotion, where it fits: one that is more than its lines' weights together is not spread."""
    total = F.sum(F.greatest(F.col(weight), F.lit(0))).over(Window.partitionBy(doc))
    fits = rows.withColumn("__discount", F.when((total > 0) & (F.col(discount) <= total), F.col(discount)).otherwise(0))
    return largest_remainder(fits, doc, position, "__discount", weight, out).drop("__discount")


def rounded_with_rest(rows: DataFrame, group: str, part: str, exact: str, out: str = "rounded") -> DataFrame:
    """Each part rounded to the cent, and what the rounding lost given to the part with the largest absolute amount."""
    whole = Window.partitionBy(group)
    rows = rows.withColumn("__r", F.round(F.col(exact), 2)).withColumn("__total", F.round(F.sum(exact).over(whole), 2))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.abs(F.col(exact)).desc(), F.col(part))) == 1
    rest = F.col("__total") - F.sum("__r").over(whole)
    rows = rows.withColumn("__rest", rest).withColumn("__first", first)
    return rows.withColumn(out, F.col("__r") + F.when(F.col("__first"), F.col("__rest")).otherwise(0)).drop("__r", "__total", "__rest", "__first")


def pie(rows: DataFrame, group: str, part: str, amount: str, least: float = 0.005, others: str = "others") -> DataFrame:
    """Slices of each group: parts under ``least`` of it fold into ``others``, unless only one is so small."""
    whole = Window.partitionBy(group)
    share = F.try_divide(F.col(amount).cast("double"), F.sum(amount).over(whole).cast("double"))
    rows = rows.withColumn("__share", share).withColumn("__small", F.col("__share") < least)
    fold = F.col("__small") & (F.sum(F.col("__small").cast("int")).over(whole) > 1)
    return rows.withColumn("slice", F.when(fold, F.lit(others)).otherwise(F.col(part))).groupBy(group, "slice").agg(F.sum(amount).alias(amount), F.count("*").alias("n_parts"))
