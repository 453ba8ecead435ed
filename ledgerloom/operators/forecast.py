"""Purchase rhythm: gaps between visits, habit, need, chance, trend, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Constants of the chance and the labels.
BIAS, SLOPE, FEW_PENALTY, FEW = 0.39, 0.82, 2.00, 3
NEED_LOW, NEED_HIGH, CLAMP = 0.1, 2.0, 1e-4
MEMORY_DAYS, PRIOR_VISITS, PRIOR_CHANCE, HALF_LIFE = 180.0, 1.0, 0.10, 90.0
DROP_FACTOR, DROP_DAYS, TREND_UP, TREND_DOWN, TREND_DAYS = 3, 60, 1.5, 0.5, 90
BUY_AT, MAYBE_AT = 0.25, 0.125


def last_gaps(days: DataFrame, key: str, day: str, last: int = 30) -> DataFrame:
    """Median of the last ``last`` gaps between distinct days of each key, and how many there were."""
    days = days.select(key, day).distinct()
    w = Window.partitionBy(key).orderBy(day)
    newest = Window.partitionBy(key).orderBy(F.desc(day))
    gaps = days.withColumn("gap", F.datediff(day, F.lag(day).over(w))).withColumn("r", F.row_number().over(newest)).filter((F.col("r") <= last) & F.col("gap").isNotNull())
    return gaps.groupBy(key).agg(F.median("gap").alias("usual_gap"), F.count("*").alias("n_gaps"))


def rhythm(purchases: DataFrame, key: str) -> DataFrame:
    """Purchase days of each key: number, first, last, median and spread of gaps, usual quantity (median of the last three
    days), and what that makes of it."""
    per = purchases.groupBy(key, "day").agg(F.sum("quantity").alias("q"))
    w, newest = Window.partitionBy(key).orderBy("day"), Window.partitionBy(key).orderBy(F.desc("day"))
    rows = per.withColumn("gap", F.datediff("day", F.lag("day").over(w)).cast("double")).withColumn("r", F.row_number().over(newest))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.median("gap").alias("median_gap"), F.try_divide(F.stddev_pop("gap"), F.avg("gap")).alias("variation"),
        F.median(F.when(F.col("r") <= 3, F.col("q").cast("double"))).alias("usual_quantity"),
    )
    return out


def state(rows: DataFrame, today: Column) -> Column:
    silent = F.datediff(today, F.col("last_day"))
    dropped = silent > F.greatest(DROP_FACTOR * F.coalesce("median_gap", F.lit(0.0)), F.lit(DROP_DAYS))
    return F.when(F.col("n_days") == 1, "one_off").when(dropped, "dropped").when(F.col("n_days") < FEW, "new").when(F.col("variation") <= 0.5, "regular").otherwise("irregular")


def habit(purchase_days: DataFrame, visits: DataFrame, today: Column) -> DataFrame:
    """(store, article, habit): the decayed share of a store's visits, since the article was first bought anywhere, that
    bought it there. Visits are summed in order of day once, so no purchase meets every visit."""
    weight = F.pow(F.lit(0.5), F.datediff(today, F.col("day")) / MEMORY_DAYS)
    up = Window.partitionBy("store").orderBy("day")
    total = Window.partitionBy("store")
    seen = visits.select("store", "day").distinct().withColumn("w", weight)
    seen = seen.withColumn("from_here", F.sum("w").over(total) - F.sum("w").over(up) + F.col("w"))
    first = purchase_days.groupBy("article").agg(F.min("day").alias("first_day"))
    bought = purchase_days.groupBy("store", "article").agg(F.sum(weight).alias("here"), F.count("*").alias("n_days")).join(first, "article")
    # The first visit on or after the article's first day, found by a sorted pass over both.
    asked = bought.select("store", F.col("first_day").alias("day"), "article", F.lit(0).alias("side"), F.lit(None).cast("double").alias("from_here"))
    marks = seen.select("store", "day", F.lit(None).cast("string").alias("article"), F.lit(1).alias("side"), "from_here")
    down = Window.partitionBy("store").orderBy(F.desc("day"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    since = asked.unionByName(marks).withColumn("all", F.last("from_here", ignorenulls=True).over(down)).filter("side = 0").select("store", "article", "all")
    share = (F.col("here") + PRIOR_VISITS * PRIOR_CHANCE) / (F.coalesce("all", F.lit(0.0)) + PRIOR_VISITS)
    return bought.join(since, ["store", "article"]).select("store", "article", "n_days", share.alias("habit"))


def calendar_need(last_day: Column, last_quantity: Column, rate: Column, today: Column, horizon: int) -> Column:
    """How used up the last purchase is by the calendar: days since it, and to come, over the days that it lasts."""
    return F.try_divide((F.datediff(today, last_day) + horizon).cast("double"), F.try_divide(last_quantity, rate))


#: Bounds of the ratio between what was bought and what the till poured.
RATIO_LOW, RATIO_HIGH = 0.25, 5.0


def till_need(sold_since: Column, sold_rate: Column, bought: Column, poured: Column, last_quantity: Column, horizon: int) -> Column:
    """The same by the till: what it sold since, and will, at the ratio of purchases to sales over the time that both cover."""
    ratio = F.least(F.greatest(F.coalesce(F.try_divide(bought, poured), F.lit(1.0)), F.lit(RATIO_LOW)), F.lit(RATIO_HIGH))
    return F.try_divide(ratio * (sold_since + sold_rate * horizon), last_quantity)


def chance(share: Column, need: Column, few: Column) -> Column:
    """sigmoid(logit(habit) + bias + slope ln(need) - penalty for few purchases), all within clamps."""
    p = F.least(F.greatest(share, F.lit(CLAMP)), F.lit(1 - CLAMP))
    n = F.least(F.greatest(need, F.lit(NEED_LOW)), F.lit(NEED_HIGH))
    z = F.ln(p / (1 - p)) + BIAS + SLOPE * F.ln(n) - F.when(few, F.lit(FEW_PENALTY)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def trend(purchases: DataFrame, key: str, today: Column) -> DataFrame:
    """Rate of the last 90 days against that of the rest of the year."""
    age = F.datediff(today, F.col("day"))
    rows = purchases.groupBy(key).agg(F.sum(F.when((age >= 0) & (age < TREND_DAYS), F.col("quantity")).otherwise(0)).cast("double").alias("recent"), F.sum(F.when((age >= TREND_DAYS) & (age < 365), F.col("quantity")).otherwise(0)).cast("double").alias("before"))
    ratio = F.try_divide(F.col("recent") / TREND_DAYS, F.col("before") / (365 - TREND_DAYS))
    label = F.when(ratio.isNull(), "unknown").when(ratio >= TREND_UP, "up").when(ratio <= TREND_DOWN, "down").otherwise("flat")
    return rows.withColumn("ratio", ratio).withColumn("trend", label)
