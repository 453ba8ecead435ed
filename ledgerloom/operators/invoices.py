"""Invoices: totals by rule, checks, states; variations; usual prices; chains of replacements and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import cents
from ledgerloom.sources.scratch import written


def totals(lines: DataFrame, stated: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """(doc, total, rule). ``lines``: doc, ht, vat, printed (null if none), promotion; ``stated``: doc, printed_total.

    Where every line has a printed amount their sum rules; else HT with VAT does; the document's own total is taken where it
    is near enough: within the tolerance of the first, or a cent a rate of the second.
    """
    per = lines.groupBy("doc").agg(
        F.bool_and(F.col("printed").isNotNull()).alias("all_printed"), F.sum(F.col("printed") - F.coalesce("promotion", F.lit(0))).alias("p"), F.sum(F.col("ht") * (1 + F.col("vat"))).alias("t"), F.count_distinct("vat").alias("rates"),
    )
    rows = per.join(stated, "doc", "left")
    near_p = F.abs(F.col("printed_total") - F.col("p")) <= F.lit(tolerance).cast("decimal(6,2)")
    near_t = F.abs(F.col("printed_total") - F.col("t")) <= F.lit("0.01").cast("decimal(4,2)") * F.greatest("rates", F.lit(1))
    rule = F.when(F.col("all_printed"), F.when(near_p, "stated").otherwise("printed")).otherwise(F.when(near_t, "stated").otherwise("computed"))
    total = F.when(rule == "stated", F.col("printed_total")).when(rule == "printed", F.col("p")).otherwise(cents(F.col("t")))
    return rows.select("doc", total.alias("total"), rule.alias("rule"))


def payment_state(due: Column, paid: Column) -> Column:
    return F.when(paid <= 0, "unpaid").when(paid < due, "partly").when(paid == due, "paid").otherwise("over")


def variation_at(groups: DataFrame) -> DataFrame:
    """(recipe_id, n, products): every variation of every recipe, by mixed-radix number: the first group turns fastest.
    ``groups``: recipe_id, grp, options (sorted array). Numbers are made in blocks of up to a million, so that a recipe with very
    many ways is spread over rows before they are listed."""
    per = groups.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("grp", "options"))).alias("groups"))
    ways = F.aggregate("groups", F.lit(1).cast("long"), lambda a, g: a * F.size(g["options"]))
    block = F.lit(1_000_000).cast("long")
    rows = per.withColumn("ways", ways).filter("ways > 0").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1, block)))
    rows = rows.withColumn("n", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + block, F.col("ways")) - 1)))
    start = F.struct(F.col("n").alias("rest"), F.array().cast("array<bigint>").alias("picked"))
    pick = F.aggregate("groups", start, lambda a, g: F.struct(F.floor(a["rest"] / F.size(g["options"])).alias("rest"), F.concat(a["picked"], F.array(F.element_at(g["options"], (a["rest"] % F.size(g["options"]) + 1).cast("int")))).alias("picked")), lambda a: a["picked"])
    return rows.select("recipe_id", "n", pick.alias("products"))


def usual_price(rows: DataFrame, key: str) -> DataFrame:
    """The price that most units of a key were sold at, the higher of a tie. ``rows``: key, day, quantity, revenue."""
    daily = rows.groupBy(key, "day").agg(F.sum("quantity").alias("q"), F.sum("revenue").alias("r")).filter("q > 0")
    # Exact half-up to the cent, in whole numbers.
    cent, unit = (F.col("r") * 100).cast("decimal(38,0)"), (F.col("q") * 1000).cast("decimal(38,0)")
    daily = daily.withColumn("price", F.floor(((cent * 2000 + unit) / (unit * 2)).cast("decimal(30,6)")).cast("double") / 100)
    priced = daily.groupBy(key, "price").agg(F.sum("q").alias("units"))
    return priced.groupBy(key).agg(F.max_by("price", F.struct("units", "price")).alias("price"), F.max("units").alias("units"))


def valid_at(asked: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``asked`` (key, day) with the latest label of the key that is valid from its day or before: one sorted pass."""
    kind = labels.schema["label"].dataType
    a = asked.withColumn("__side", F.lit(1)).withColumn("__label", F.lit(None).cast(kind))
    b = labels.select(key, F.col("valid_from").alias("day"), F.lit(0).alias("__side"), F.col("label").alias("__label"))
    w = Window.partitionBy(key).orderBy("day", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("label", F.last("__label", ignorenulls=True).over(w))
    return both.filter("__side = 1").drop("__side", "__label")


def final_versions(rows: DataFrame) -> DataFrame:
    """(id, final_id): where a chain of replacements (id, replaced_by) ends, by pointer doubling: rounds grow with the
    logarithm of the longest chain. A ring ends nowhere: all on it, and all that lead into it, get its smallest id.

    Each pointer carries whether its chain has ended and the smallest id that it jumps over. What has not ended when jumps are
    longer than the table points into a ring, and its target's pointer has been all the way round."""
    to = F.coalesce("replaced_by", "id")
    now = written(rows.select("id", to.alias("final_id"), to.alias("least"), (to == F.col("id")).alias("ended")))
    n, jump = now.count(), 1
    while jump <= 2 * n:
        met = now.alias("a").join(now.alias("b"), F.col("a.final_id") == F.col("b.id"), "left")
        # An id that has no row of its own is where its chain ends.
        now = written(met.select("a.id", F.coalesce("b.final_id", "a.final_id").alias("final_id"), F.least("a.least", "b.least").alias("least"), F.coalesce("b.ended", F.lit(True)).alias("ended")))
        jump *= 2
        if now.filter("not ended").isEmpty():
            return now.select("id", "final_id")
    ring = now.filter("not ended").select(F.col("id").alias("final_id"), F.col("least").alias("ring"))
    return now.join(ring, "final_id", "left").select("id", F.when(F.col("ended"), F.col("final_id")).otherwise(F.col("ring")).alias("final_id"))


def broken_links(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a hash chain whose ``previous_hash`` is not the hash before them."""
    before = F.lag("hash").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("expected", F.coalesce(before, F.lit(""))).filter(~F.col("previous_hash").eqNullSafe(F.col("expected")))


def differences(stored: DataFrame, made: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows differ: only stored, only made, or changed, with the columns that changed."""
    a = stored.select(*key, F.struct(*columns).alias("a"))
    b = made.select(*key, F.struct(*columns).alias("b"))
    rows = a.join(b, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("b").isNull(), "only_stored").when(F.col("a").isNull(), "only_made").otherwise("changed")
    out = rows.select(*key, kind.alias("kind"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("columns"))
    return out.filter((F.col("kind") != "changed") | (F.col("columns") != ""))
