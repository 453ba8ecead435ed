"""Stock from the ledger: balances, prices, containers, FIFO value."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import cents
from ledgerloom.functions.windows import between_counts


def ledger_totals(movements: DataFrame, products: DataFrame, *by: str) -> DataFrame:
    """Balance, value and purchases by columns of ``products``. Movements are summed by product first, so that only one row
    a product meets the product table."""
    bought = F.col("kind") == "PURCHASE"
    ttc = cents(F.col("ht") * (1 + F.col("vat")))
    per = movements.groupBy("product_id").agg(
        F.sum("quantity").alias("q"), F.sum("ht").alias("h"), F.sum(ttc).alias("t"), F.sum(F.when(bought, F.col("quantity"))).alias("bq"), F.sum(F.when(bought, F.col("ht"))).alias("bh"),
        F.max(F.when(bought & (F.col("quantity") > 0), F.col("day"))).alias("last"), F.count("*").alias("n"),
    )
    units = F.col("stock_equivalent")
    return per.join(products, "product_id").groupBy(*by).agg(
        F.sum(F.col("q") * units).alias("quantity"), F.sum("h").alias("value_ht"), F.sum("t").alias("value_ttc"), F.sum(F.col("bq") * units).alias("bought_quantity"),
        F.sum("bh").alias("bought_ht"), F.max("last").alias("last_purchase"), F.sum("n").alias("n_movements"),
    )


def average_cost(value: Column, quantity: Column) -> Column:
    """Value over quantity of the signed ledger; 0 where nothing is left."""
    return F.coalesce(F.try_divide(value.cast("double"), quantity.cast("double")), F.lit(0.0))


def between(movements: DataFrame, products: DataFrame, start: date, end: date) -> DataFrame:
    """Purchases, losses and latest purchase day of each article in (start, end]."""
    inside = movements.filter(between_counts(F.col("day"), start, end))
    per = inside.groupBy("product_id").agg(F.sum(F.when(F.col("kind") == "PURCHASE", F.col("quantity")).otherwise(0)).alias("p"), F.sum(F.when(F.col("kind") == "LOSS", -F.col("quantity")).otherwise(0)).alias("l"), F.max(F.when((F.col("kind") == "PURCHASE") & (F.col("quantity") > 0), F.col("day"))).alias("d"))
    units = F.col("stock_equivalent")
    return per.join(products, "product_id").groupBy("article").agg(F.sum(F.col("p") * units).alias("purchased"), F.sum(F.col("l") * units).alias("lost"), F.max("d").alias("last_purchase"))


def price_points(rows: DataFrame, *by: str) -> DataFrame:
    """Price by key: value over quantity, both absolute (the mean weighted by absolute quantity), so that sums are exact; the
    plain mean of ``price`` where all quantities are 0."""
    weighted = F.try_divide(F.sum(F.abs("value")).cast("double"), F.sum(F.abs("quantity")).cast("double"))
    return rows.groupBy(*by).agg(F.coalesce(weighted, F.avg(F.col("price").cast("double"))).alias("price"), F.count("*").alias("n_lines"))


def usual_container(rows: DataFrame, key: str, size: str) -> DataFrame:
    """The most frequent size of each key, the larger of a tie. Sizes are counted first."""
    counted = rows.groupBy(key, size).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max_by(size, F.struct("n", size)).alias(size), F.max("n").alias("n_lines"))


def fifo_layers(ladder: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The purchases that make up what was counted, newest first, with what each gives (``taken``).

    ``ladder``: key, day (null: oldest), order columns in ``tie``, quantity, cost; only positive quantities take part.
    ``counts``: key, counted. The last row visited (``oldest``) prices a shortfall.
    """
    newest = Window.partitionBy(key).orderBy(F.col("day").desc_nulls_last(), F.col("tie").desc())
    rows = ladder.filter("quantity > 0").join(counts, key)
    rows = rows.withColumn("upto", F.sum("quantity").over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("quantity"))
    used = rows.filter(F.col("before") < F.col("counted"))
    return used.withColumn("taken", F.least("quantity", F.col("counted") - F.col("before"))).withColumn("is_last", F.col("upto") >= F.col("counted"))


def _worth(units: Column) -> Column:
    """``units`` at the row's cost, in hundredths of a thousandth, cut: whole numbers, so that sums are exact in any order."""
    whole = lambda x, by: (x * by).cast("decimal(38,0)")
    top = (whole(F.col("cost"), 100) * whole(units, 1000)).cast("decimal(38,0)") * F.lit(1000)
    return F.call_function("div", top.cast("decimal(38,0)"), whole(F.col("quantity"), 1000))


def fifo_valuation(ladder: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Value of what was counted at its newest purchases' cost; what they do not cover is priced at the oldest of them."""
    layers = fifo_layers(ladder, counts, key).withColumn("missing", F.greatest(F.col("counted") - F.col("upto"), F.lit(0)))
    oldest = F.min_by(_worth(F.col("missing")), -F.col("before"))
    per = layers.groupBy(key).agg(F.sum(_worth(F.col("taken"))).alias("covered"), F.sum("taken").alias("taken"), oldest.alias("rest"), F.count("*").alias("n_layers"))
    out = counts.join(per, key, "left")
    short = (F.col("counted") - F.coalesce("taken", F.lit(0))).cast("double")
    value = (F.coalesce("covered", F.lit(0)) + F.coalesce("rest", F.lit(0))).cast("double") / 100000
    return out.select(key, F.col("counted").cast("double").alias("counted"), value.alias("value_ht"), short.alias("shortfall"), F.coalesce("n_layers", F.lit(0)).cast("long").alias("n_layers"))
