"""Bank: balances as of a day, gaps between typed balances, months, payouts of card sales, income and spending."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.scratch import written
from ledgerloom.sources.ship import ship


def running(daily: DataFrame, key: str, day: str, amount: str, out: str) -> DataFrame:
    """Running sum by day; days are summed first, so a window holds one row a day and key."""
    per = daily.groupBy(key, day).agg(F.sum(amount).alias("__a"))
    return per.withColumn(out, F.sum("__a").over(Window.partitionBy(key).orderBy(day))).drop("__a")


def balances(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Balance at the end of every day that has lines or a typed balance: account, day, balance, moved.

    Counted from the last typed balance on or before the day, or from the first one for days before it.
    """
    moved = lines.groupBy("account", "day").agg(F.sum("amount").alias("moved"))
    days = moved.join(points, ["account", "day"], "full").withColumn("moved", F.coalesce("moved", F.lit(0)))
    to_day = Window.partitionBy("account").orderBy("day")
    whole = Window.partitionBy("account")
    days = days.withColumn("s", F.sum("moved").over(to_day)).withColumn("known", F.when(F.col("balance").isNotNull(), F.struct("balance", "s")))
    ref = F.coalesce(F.last("known", ignorenulls=True).over(to_day), F.min_by("known", F.when(F.col("known").isNotNull(), F.col("day"))).over(whole))
    days = days.withColumn("ref", ref).filter("ref is not null")
    return days.select("account", "day", (F.col("ref.balance") + F.col("s") - F.col("ref.s")).alias("balance"), "moved")


def gaps(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Between neighbouring typed balances: what the operations do not explain (``missing``); a point is suspect if the raw
    gaps around it cancel out."""
    moved = lines.groupBy("account", "day").agg(F.sum("amount").alias("moved"))
    days = moved.join(points, ["account", "day"], "full").withColumn("moved", F.coalesce("moved", F.lit(0)))
    order = Window.partitionBy("account").orderBy("day")
    typed = days.withColumn("s", F.sum("moved").over(order)).filter("balance is not null")
    typed = typed.withColumn("missing", F.col("balance") - F.lag("balance").over(order) - (F.col("s") - F.lag("s").over(order)))
    after = F.lead("missing").over(order)
    return typed.withColumn("suspect", F.coalesce((F.col("missing") != 0) & (F.col("missing") + after == 0), F.lit(False))).select("account", "day", "balance", "missing", "suspect")


def complete_through(lines: DataFrame) -> DataFrame:
    """(account, complete_through): the last day of each account that no later import can still add to. ``lines`` has
    account, day and imported_on. The last day counts if one of its lines came in on a later day, else the day before; never
    beyond the day before the newest import."""
    ends = lines.groupBy("account").agg(F.max("day").alias("last"), F.max("imported_on").alias("newest"), F.max_by("imported_on", F.struct("day", "imported_on")).alias("of_last"))
    whole = F.when(F.col("of_last") > F.col("last"), F.col("last")).otherwise(F.date_sub("last", 1))
    return ends.select("account", F.least(whole, F.date_sub("newest", 1)).alias("complete_through"))


def months(lines: DataFrame) -> DataFrame:
    """Credits, debits, net and closing of each month between an account's first and last, empty months too."""
    month = F.trunc("day", "MM").alias("month")
    per = lines.groupBy("account", month).agg(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("credits"), F.sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(0)).alias("debits"), F.count("*").alias("n_lines"))
    spine = per.groupBy("account").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("account", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    rows = spine.join(per, ["account", "month"], "left").fillna(0, ["n_lines"])
    for c in ("credits", "debits"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    net = F.col("credits") + F.col("debits")
    return rows.withColumn("net", net).withColumn("closing", F.sum("net").over(Window.partitionBy("account").orderBy("month")))


def _ledger(lines: DataFrame, points: DataFrame, adjustments: DataFrame) -> DataFrame:
    """A row for each account and day that has anything: moved, adjusted, balance (null where none was typed), running sums ``s``
    and ``t``. An adjustment counts after the first typed balance, up to the last."""
    span = points.groupBy("account").agg(F.min("day").alias("p0"), F.max("day").alias("p1"))
    counted = adjustments.join(span, "account").filter((F.col("day") > F.col("p0")) & (F.col("day") <= F.col("p1"))).groupBy("account", "day").agg(F.sum("amount").alias("adjusted"))
    moved = lines.groupBy("account", "day").agg(F.sum("amount").alias("moved"))
    days = moved.join(points, ["account", "day"], "full").join(counted, ["account", "day"], "full")
    order = Window.partitionBy("account").orderBy("day")
    days = days.select("account", "day", F.coalesce("moved", F.lit(0)).alias("moved"), F.coalesce("adjusted", F.lit(0)).alias("adjusted"), "balance")
    return days.withColumn("s", F.sum("moved").over(order)).withColumn("t", F.sum("adjusted").over(order))


def _gap_rows(ledger: DataFrame, complete: DataFrame) -> DataFrame:
    order = Window.partitionBy("account").orderBy("day")
    typed = ledger.filter("balance is not null").join(complete, "account", "left")
    change = lambda c: F.col(c) - F.lag(c).over(order)
    typed = typed.withColumn("raw", change("balance") - change("s")).withColumn("missing", F.col("raw") - change("t"))
    typed = typed.withColumn("pending", F.coalesce(F.col("day") > F.col("complete_through"), F.lit(True))).withColumn("open", F.coalesce((F.col("missing") != 0) & ~F.col("pending"), F.lit(False)))
    after = lambda c: F.lead(c).over(order)
    suspect = (F.col("raw") != 0) & (F.col("raw") == -after("raw")) & ~F.col("pending") & ~after("pending") & (F.col("open") | after("open"))
    own, before = F.col("moved"), F.lag("moved").over(order)
    read = F.when(F.col("open") & (own != 0) & (F.col("missing") == -own), "after").when(F.col("open") & (before != 0) & (F.col("missing") == before), "before")
    return typed.withColumn("suspect", F.coalesce(suspect, F.lit(False))).withColumn("read_before", read)


def gap_report(lines: DataFrame, points: DataFrame, adjustments: DataFrame, complete: DataFrame) -> DataFrame:
    """Of every typed balance but an account's first: what neither operations nor adjustments since the one before explain
    (``missing``), whether it still waits for lines (``pending``: after ``complete_through``) or is to be resolved (``open``),
    whether the point itself is suspect (the raw gaps around it cancel out and none is pending), and whose day's operations a
    balance that was read too early lacks (``read_before``)."""
    rows = _gap_rows(_ledger(lines, points, adjustments), complete).filter("missing is not null")
    return rows.select("account", "day", "missing", "pending", "open", "suspect", "read_before")


def month_rows(lines: DataFrame, points: DataFrame, adjustments: DataFrame, complete: DataFrame) -> DataFrame:
    """Every month from an account's first line or point to its last, clipped to that span: credits, debits, adjustments, the
    closing balance and whether that is provisional, and the gaps to be resolved in it, their sum and number."""
    ledger = written(_ledger(lines, points, adjustments))
    month = F.trunc("day", "MM")
    parts = lines.groupBy("account", month.alias("month")).agg(F.sum(F.greatest("amount", F.lit(0))).alias("credits"), F.sum(F.least("amount", F.lit(0))).alias("debits"))
    adjusted = ledger.groupBy("account", month.alias("month")).agg(F.sum("adjusted").alias("adjustments"))
    gaps_ = _gap_rows(ledger, complete).groupBy("account", month.alias("month")).agg(F.sum(F.when(F.col("open"), F.col("missing")).otherwise(0)).alias("gap"), F.count_if("open").alias("n_gaps"))
    span = ledger.groupBy("account").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.min_by("balance", F.when(F.col("balance").isNotNull(), F.col("day"))).alias("balance0"), F.min(F.when(F.col("balance").isNotNull(), F.struct("day", "s", "t"))).alias("first"))
    spine = span.select("account", "a", "b", "balance0", "first", F.explode(F.expr("sequence(trunc(a, 'MM'), trunc(b, 'MM'), interval 1 month)")).alias("month"))
    spine = spine.withColumn("start", F.greatest("month", "a")).withColumn("end", F.least(F.last_day("month"), "b"))
    # What the ledger says at a month's end is what it said on the last of its days up to then.
    at = ledger.groupBy("account", month.alias("month")).agg(F.max_by(F.struct("s", "t"), "day").alias("sums"), F.max(F.when(F.col("balance").isNotNull(), F.struct("day", "balance", "s", "t"))).alias("point"))
    rows = spine.join(at, ["account", "month"], "left").join(parts, ["account", "month"], "left").join(adjusted, ["account", "month"], "left").join(gaps_, ["account", "month"], "left").join(complete, "account", "left")
    upto = Window.partitionBy("account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("sums", "point"):
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(upto))
    ref = lambda c: F.coalesce(F.col("point")[c], F.col("balance0") if c == "balance" else F.col("first")[c])
    closing = ref("balance") + F.col("sums.s") - ref("s") + F.col("sums.t") - ref("t")
    late = lambda day: F.coalesce(day > F.col("complete_through"), F.lit(True))
    provisional = F.when(F.col("point.day") == F.col("end"), False).when(F.col("point").isNotNull(), late(F.col("end"))).otherwise(late(F.col("first.day"))) & ref("balance").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("account", "month", "start", "end", zero("credits"), zero("debits"), zero("adjustments"), closing.alias("closing"), provisional.alias("provisional"), zero("gap"), F.coalesce("n_gaps", F.lit(0)).cast("long").alias("n_gaps"))


def unpaid_after_payouts(sold: DataFrame, payouts: DataFrame) -> DataFrame:
    """(key, day, gross, unpaid): card sales strictly before each payout day, since the anchor, less payouts so far.

    The anchor is the day of the seven before the first payout whose sales since then come nearest to it, the latest of ties.
    ``sold``: key, day, amount; ``payouts``: key, day, gross (one row a day).
    """
    start = sold.groupBy("key").agg(F.min("day").alias("first_day"))
    paid = payouts.join(start, "key").filter("day > first_day")
    first = paid.groupBy("key").agg(F.min("day").alias("t1"), F.min_by("gross", "day").alias("g1"), F.first("first_day").alias("first_day"))
    events = sold.select("key", "day", "amount", F.lit(None).cast("decimal(22,2)").alias("gross")).unionByName(paid.select("key", "day", F.lit(0).cast("decimal(22,2)").alias("amount"), "gross"))
    # Candidate anchors: at most seven days a key.
    days = first.select("key", "t1", "g1", F.explode(F.expr("sequence(greatest(first_day, date_sub(t1, 7)), date_sub(t1, 1))")).alias("anchor"))
    near = days.join(sold.withColumnRenamed("day", "sold_day"), "key").filter((F.col("sold_day") >= F.col("anchor")) & (F.col("sold_day") < F.col("t1")))
    since = days.join(near.groupBy("key", "anchor").agg(F.sum("amount").alias("since")), ["key", "anchor"], "left").withColumn("off", F.abs(F.coalesce("since", F.lit(0)) - F.col("g1")))
    anchors = since.groupBy("key").agg(F.min_by("anchor", F.struct("off", -F.unix_date("anchor"))).alias("anchor"))
    rows = events.join(anchors, "key").withColumn("counted", F.when(F.col("day") >= F.col("anchor"), F.col("amount")).otherwise(0))
    per = rows.groupBy("key", "day").agg(F.sum("counted").alias("sold"), F.sum("gross").alias("gross"))
    order = Window.partitionBy("key").orderBy("day")
    per = per.withColumn("before", F.coalesce(F.sum("sold").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("paid", F.sum(F.coalesce("gross", F.lit(0))).over(order))
    return per.filter("gross is not null").select("key", "day", "gross", (F.col("before") - F.col("paid")).alias("unpaid"))


#: Candidate runs of one group of islands, about.
RUN_ROWS = 50_000


def exact_runs(sold: DataFrame, payouts: DataFrame, back: int = 8) -> DataFrame:
    """(key, day, gross, first_day, last_day): for payouts in date order, the unclaimed run of consecutive card days ending
    one to ``back`` days before whose sum is the gross: the latest end, then the shortest.

    A run is two points of the running sum that differ by the gross: an equi-join finds every run a payout could claim. Payouts
    compete only where these overlap, so they fall apart in islands of days, from a run's first day to its payout; each is settled
    in one task, whole, many small ones together."""
    order = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cents = lambda c: (F.col(c) * 100).cast("long")
    days = sold.groupBy("key", "day").agg(F.sum(cents("amount")).alias("c")).filter("c != 0").withColumn("hi", F.sum("c").over(order)).withColumn("lo", F.col("hi") - F.col("c"))
    asked = payouts.select("key", "day", cents("gross").alias("want"))
    asked = asked.withColumn("no", F.row_number().over(Window.partitionBy("key", "day", "want").orderBy("want")))
    asked = asked.withColumn("last_day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(back)), lambda i: F.date_sub("day", i))))
    ends = asked.join(days.select("key", F.col("day").alias("last_day"), "hi"), ["key", "last_day"])
    starts = days.select("key", F.col("day").alias("first_day"), "lo")
    runs = ends.withColumn("lo", F.col("hi") - F.col("want")).join(starts, ["key", "lo"]).filter("first_day <= last_day").select("key", "day", "want", "no", "first_day", "last_day")
    w = Window.partitionBy("key").orderBy("first_day", "day", "want", "no", "last_day")
    reach = F.max("day").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", (reach.isNull() | (F.col("first_day") >= reach)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "island", "day", "want", "no", "last_day", "first_day"], ascending=[True, True, True, True, True, False, False])
        out, claimed, paid = [], {}, set()
        for r in rows.itertuples():
            mine, payout = claimed.setdefault((r.key, r.island), []), (r.key, r.day, r.want, r.no)
            if payout not in paid and all(r.last_day < a or r.first_day > b for a, b in mine):
                paid.add(payout)
                mine.append((r.first_day, r.last_day))
                out.append((r.key, r.day, r.want / 100, r.first_day, r.last_day))
        return pd.DataFrame(out, columns=["key", "day", "gross", "first_day", "last_day"])

    ship(sold.sparkSession)
    rows = written(runs.drop("new"))
    groups = max(1, math.ceil(rows.count() / RUN_ROWS))
    return rows.withColumn("part", F.pmod(F.xxhash64("key", "island"), F.lit(groups))).groupBy("part").applyInPandas(settle, "key string, day date, gross double, first_day date, last_day date")


def waterfall(credits: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, credit_id, doc_id, share): positive credits of a key in order over its documents in order, each taking what is
    still asked. Both are laid end to end; every stretch between two ends has one credit and one document, so two sorted
    passes do it, however many there are of a key."""
    end = lambda df, by, x: F.sum(x).over(Window.partitionBy("key").orderBy(by, "id").rowsBetween(Window.unboundedPreceding, 0)).alias("hi")
    none = F.lit(None).cast("long")
    c = credits.select("key", end(credits, "day", "amount"), F.col("id").alias("c"), none.alias("d"))
    d = asked.select("key", end(asked, "day", "due"), none.alias("c"), F.col("id").alias("d"))
    ends = c.unionByName(d).groupBy("key", "hi").agg(F.max("c").alias("c"), F.max("d").alias("d"))
    down = Window.partitionBy("key").orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, 0)
    lo = F.coalesce(F.lag("hi").over(Window.partitionBy("key").orderBy("hi")), F.lit(0))
    cut = ends.select("key", F.last("c", ignorenulls=True).over(down).alias("credit_id"), F.last("d", ignorenulls=True).over(down).alias("doc_id"), (F.col("hi") - lo).alias("share"))
    return cut.filter("credit_id is not null and doc_id is not null")
