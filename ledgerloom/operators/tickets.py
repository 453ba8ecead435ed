"""Tickets that were read: one wrong amount put right, items split over two rates; both only where there is a single way."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import likeness

#: How alike two readings of one name are at least; in how many ways items can be split at most.
ALIKE, MOST_WAYS = 80, 200_000

AMOUNT = "decimal(14,2)"


def repaired(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(ticket, item, was, total) of each ticket that misses its target and that one correction alone makes add up.

    ``items``: ticket, item, name, total, count (null: one); ``targets``: ticket, target. An item can have the amount of another
    of a like name and the same count, or its own without the first digit or two, which were a rate's code. What an item would
    have to be is known from the gap, so other items are found by equality of amounts. A correction to nothing or less is a way
    too, but is not made.
    """
    rows = items.select("ticket", "item", "name", F.col("total").cast(AMOUNT).alias("total"), F.coalesce("count", F.lit(1)).alias("count"))
    gaps = rows.groupBy("ticket").agg(F.sum("total").alias("sum")).join(targets, "ticket").select("ticket", (F.col("target") - F.col("sum")).cast(AMOUNT).alias("gap")).filter("gap <> 0")
    wrong = rows.join(gaps, "ticket").select("ticket", "item", "name", "count", "total", (F.col("total") + F.col("gap")).cast(AMOUNT).alias("value"))
    text = F.col("total").cast("string")
    shorter = [(F.length(text) - cut >= 4) & (F.substring(text, cut + 1, 40).try_cast(AMOUNT) == F.col("value")) for cut in (1, 2)]
    others = rows.select("ticket", F.col("item").alias("__item"), F.col("name").alias("__name"), "count", F.col("total").alias("value"))
    priced = wrong.join(others, ["ticket", "count", "value"]).filter(F.col("item") != F.col("__item")).filter(likeness(F.col("name"), F.col("__name")) >= ALIKE)
    columns = ("ticket", "item", "total", "value")
    ways = wrong.filter(F.coalesce(shorter[0] | shorter[1], F.lit(False))).select(*columns).unionByName(priced.select(*columns)).distinct()
    one = ways.groupBy("ticket").agg(F.count("*").alias("n"), F.first("item").alias("item"), F.first("total").alias("was"), F.first("value").alias("total"))
    return one.filter("n = 1 and total > 0").drop("n")


def split_rates(items: DataFrame, buckets: DataFrame) -> DataFrame:
    """(ticket, name, net, n, n_first): how many of each item have the first of a ticket's two rates, where only one split makes
    both sums come out within a cent.

    ``items``: ticket, name, net, one row each; ``buckets``: ticket, first, second. Equal items are one group of which some
    number is taken; tickets with more than ``MOST_WAYS`` splits are left out before any list is made.
    """
    groups = items.groupBy("ticket", "name", F.col("net").cast(AMOUNT).alias("net")).agg(F.count("*").cast("int").alias("n"))
    few = groups.groupBy("ticket").agg(F.sum(F.ln(F.col("n") + 1)).alias("ways")).filter(F.col("ways") <= math.log(MOST_WAYS) + 1e-9)
    per = groups.join(few.select("ticket"), "ticket").groupBy("ticket").agg(F.array_sort(F.collect_list(F.struct("name", "net", "n"))).alias("groups"), F.sum(F.col("net") * F.col("n")).cast(AMOUNT).alias("all"))
    none = F.array(F.struct(F.lit(0).cast(AMOUNT).alias("sum"), F.lit(0).cast("long").alias("code")))
    take = lambda way, g, t: F.struct((way["sum"] + g["net"] * t).cast(AMOUNT).alias("sum"), (way["code"] * (g["n"] + 1) + t).cast("long").alias("code"))
    ways = F.aggregate("groups", none, lambda found, g: F.flatten(F.transform(found, lambda way: F.transform(F.sequence(F.lit(0), g["n"]), lambda t: take(way, g, t)))))
    near = lambda a, b: F.abs(a - b) <= F.lit("0.01").cast("decimal(4,2)")
    good = per.withColumn("ways", ways).join(buckets, "ticket").withColumn("ways", F.filter("ways", lambda way: near(way["sum"], F.col("first")) & near(F.col("all") - way["sum"], F.col("second")))).filter("size(ways) = 1")
    # The last group is the last digit of the code.
    start = F.struct(F.col("ways")[0]["code"].alias("code"), F.array().cast("array<int>").alias("taken"))
    read = lambda at, g: F.struct(F.floor(at["code"] / (g["n"] + 1)).cast("long").alias("code"), F.concat(F.array((at["code"] % (g["n"] + 1)).cast("int")), at["taken"]).alias("taken"))
    taken = F.aggregate(F.reverse("groups"), start, read, lambda at: at["taken"])
    return good.withColumn("taken", taken).select("ticket", F.explode(F.arrays_zip("groups", "taken")).alias("x")).select("ticket", "x.groups.name", "x.groups.net", "x.groups.n", F.col("x.taken").alias("n_first"))
