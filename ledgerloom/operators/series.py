"""Daily series: decayed rates, sums over intervals, comparisons of two readings, runs that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .forecast import HALF_LIFE


def decayed_rate(rows: DataFrame, key: str, today: Column, half_life: float = HALF_LIFE) -> DataFrame:
    """(key, rate): quantity a day, each day counting half as much after every ``half_life`` days, over the same weights of all
    days since the first."""
    days = rows.groupBy(key, "day").agg(F.sum("quantity").cast("double").alias("q"))
    age = F.datediff(today, F.col("day"))
    per = days.groupBy(key).agg(F.sum(F.col("q") * F.pow(F.lit(0.5), age / half_life)).alias("weighted"), F.max(age).alias("oldest"))
    d = 0.5 ** (1 / half_life)
    return per.select(key, (F.col("weighted") / ((1 - F.pow(F.lit(d), F.col("oldest") + 1)) / (1 - d))).alias("rate"))


def sums_between(series: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``spans`` (key, id, start, end) with the sum of ``series`` (key, day, quantity) over start <= day < end: two points of a
    running sum, both found in one sorted pass, so no span meets all of its days."""
    marks = spans.select(key, F.col("start").alias("day"), "id", F.lit(-1).alias("sign")).unionByName(spans.select(key, F.col("end").alias("day"), "id", F.lit(1).alias("sign")))
    both = series.groupBy(key, "day").agg(F.sum("quantity").alias("q")).select(key, "day", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("sign"), "q").unionByName(marks.withColumn("q", F.lit(None)), allowMissingColumns=True)
    # A mark comes before its own day's quantity.
    upto = Window.partitionBy(key).orderBy("day", F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("s", F.coalesce(F.sum("q").over(upto), F.lit(0))).filter("id is not null")
    return spans.join(run.groupBy(key, "id").agg(F.sum(F.col("s") * F.col("sign")).alias("total")), [key, "id"])


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both readings of each key over the days that both cover: key, a, b, difference, and what lies outside on either side."""
    ends = lambda df, n: df.groupBy(key).agg(F.min("day").alias(f"{n}0"), F.max("day").alias(f"{n}1"))
    cover = ends(a, "a").join(ends(b, "b"), key).select(key, F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))
    inside = (F.col("day") >= F.col("lo")) & (F.col("day") <= F.col("hi"))
    part = lambda df, n: df.join(cover, key).groupBy(key).agg(F.sum(F.when(inside, F.col("amount")).otherwise(0)).alias(n), F.sum(F.when(inside, 0).otherwise(F.col("amount"))).alias(f"{n}_outside"))
    return part(a, "a").join(part(b, "b"), key).withColumn("difference", F.col("a") - F.col("b"))


def longest_run_to(rows: DataFrame, doc: str, position: str, amount: str) -> DataFrame:
    """(doc, first, last): the longest run of consecutive items that add up to the document's ``target``, the first of equals.
    A run is two points of a running sum that differ by the target: an equi-join on the sum."""
    w = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("hi", F.sum(amount).over(w)).withColumn("lo", F.col("hi") - F.col(amount))
    a = run.select(doc, F.col(position).alias("first"), (F.col("lo") + F.col("target")).alias("s"))
    b = run.select(doc, F.col(position).alias("last"), F.col("hi").alias("s"))
    met = a.join(b, [doc, "s"]).filter("last >= first")
    return met.groupBy(doc).agg(F.max_by(F.struct("first", "last"), F.struct((F.col("last") - F.col("first")).alias("n"), -F.col("first"))).alias("x")).select(doc, "x.first", "x.last")


def usual_product(rows: DataFrame, key: str, days: int = 5) -> DataFrame:
    """The product bought most on the last ``days`` purchase days of each key; of equals the one bought last, then the first."""
    at = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("day")))
    last = rows.withColumn("__r", at).filter(F.col("__r") <= days)
    per = last.groupBy(key, "product_id").agg(F.sum("quantity").alias("q"), F.max("day").alias("d"))
    return per.groupBy(key).agg(F.max_by("product_id", F.struct("q", "d", -F.col("product_id"))).alias("product_id"), F.max("q").cast("double").alias("quantity"))
