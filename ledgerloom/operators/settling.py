"""Payments settled one after another, where a claim is one document or a set that adds up.

What a payment takes depends on what earlier ones left, so a pass is sequential; but only payments that may want the same document
need to wait for each other. Those are found first, without pairs: equal totals of a key meet in runs of overlapping windows, and
a payment with few documents in reach claims the members of every sum that pays it. Components of these claims are settled each
in order, many to a task.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.graph import components
from ledgerloom.operators.matching import SEARCHED, latest_before, merged_intervals, sums_of
from ledgerloom.sources.scratch import written
from ledgerloom.sources.ship import ship

#: Rows of one task's components, about.
SETTLED_ROWS = 50_000


def _cents(name: str) -> Column:
    return (F.col(name) * 100).cast("long")


def _in_runs(asked: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """(node, run): payments and documents that the same run of overlapping windows of ``keys`` covers. A run is named by hash:
    two of one name would only be settled together. One sorted pass a key."""
    spans = asked.select(*keys, F.date_sub("day", F.col("back").cast("int")).alias("a"), F.date_add("day", F.col("ahead").cast("int")).alias("b"))
    one = merged_intervals(spans.withColumn("k", F.struct(*keys)).select("k", "a", "b"), "k", "a", "b").select("k", "a", "b")
    named = (F.shiftleft(F.xxhash64(F.lit("/".join(keys)), "k", "a"), 2) + 2).alias("run")
    # The run that began last before a day is the one that covers it, if any does.
    starts = one.select("k", F.col("a").alias("d"), F.struct(named, "b").alias("r"), F.lit(None).cast("long").alias("node"))
    days = asked.select(F.struct(*keys).alias("k"), F.date_sub("day", F.col("back").cast("int")).alias("d"), (F.col("payment_id") * 4).alias("node"))
    days = days.unionByName(documents.select(F.struct(*keys).alias("k"), F.col("invoice_day").alias("d"), (F.col("invoice_id") * 4 + 1).alias("node")))
    upto = Window.partitionBy("k").orderBy("d", F.col("node").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(days.withColumn("r", F.lit(None).cast(starts.schema["r"].dataType))).withColumn("last", F.last("r", ignorenulls=True).over(upto))
    return met.filter("node is not null and d <= last.b").select("node", "last.run")


def _in_reach(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(payment_id, key, n): how many ``documents`` of its key a payment has in its window, as the difference of two running counts."""
    none = F.lit(None).cast("long")
    at = lambda day, sign: asked.select("key", day.alias("d"), "payment_id", F.lit(0).alias("one"), F.lit(sign).alias("sign"))
    marks = at(F.date_add("day", F.col("ahead").cast("int")), 1).unionByName(at(F.date_sub("day", F.col("back").cast("int") + 1), -1))
    marks = marks.unionByName(documents.select("key", F.col("invoice_day").alias("d"), none.alias("payment_id"), F.lit(1).alias("one"), F.lit(0).alias("sign")))
    upto = Window.partitionBy("key").orderBy("d", F.col("payment_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("upto", F.sum("one").over(upto)).filter("payment_id is not null").groupBy("payment_id", "key").agg(F.sum(F.col("sign") * F.col("upto")).alias("n"))


def claims(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b): edges between payments (id * 4), documents (id * 4 + 1) and runs (.. + 2); whatever two payments may both want, or
    may have to wait for, hangs together.

    Where more than ``SEARCHED`` documents are in reach, which of them are looked at depends on what was taken, so the payment
    hangs together with all of its key's documents around it; else with those of equal total and those in a sum."""
    equal = _in_runs(asked.withColumn("cents", _cents("due")), documents.withColumn("cents", _cents("total")), "key", "cents")
    fresh = documents.filter("fresh")
    counted = written(_in_reach(asked, fresh))
    of = lambda some: asked.join(counted.filter(some).select("payment_id", "key").hint("merge"), ["payment_id", "key"])
    lists = latest_before(of(F.col("n").between(2, SEARCHED)), fresh).groupBy("payment_id", "key").agg(F.first(_cents("due")).alias("due"), F.collect_list(F.struct(F.col("invoice_id").alias("id"), _cents("total").alias("cents"))).alias("all"))
    few = lists.select("payment_id", F.explode(F.array_distinct(F.flatten(sums_of(F.col("all"), F.col("due"))))).alias("invoice_id"))
    summed = few.select((F.col("payment_id") * 4).alias("node"), (F.col("invoice_id") * 4 + 1).alias("run"))
    many = of(F.col("n") > SEARCHED)
    around = _in_runs(many, fresh, "key")
    edges = written(equal.unionByName(summed).unionByName(around))
    # A payment that wants nothing takes nothing, whatever the others do; a run without a document is nobody's claim.
    wanted = edges.groupBy("run").agg(F.max(F.col("node") % 4).alias("documents"), F.max((F.col("run") % 4 == 1).cast("int")).alias("single")).filter("documents = 1 or single = 1").select("run")
    return edges.join(wanted, "run").select(F.col("node").alias("a"), F.col("run").alias("b"))


def settle(payments: DataFrame, documents: DataFrame, back: Column, ahead: Column) -> DataFrame:
    """(payment_id, invoice_id): what each payment takes for sure of what those before it left; cards first, then by day and id.

    ``payments``: payment_id, key, day, due, card, by_label, a row for every key whose documents it names; ``documents``:
    invoice_id, key, invoice_day, total, fresh (nothing paid yet). ``back`` and ``ahead`` are the days of a payment's window.
    A payment takes the only free document of exactly its amount, by card also the strictly nearest of several; where there is
    none, the only set of two to four fresh ones of one key, of its ``SEARCHED`` latest in reach, that adds up. A document paid in
    part is never sure, nor is anything for a payment ``by_label``. Amounts of 0 or less, documents without a day or of a
    total of 0 take no part; of repeated rows one counts; empty tables give no links.
    """
    ship(payments.sparkSession)
    asked = written(payments.filter("due > 0").dropDuplicates(["payment_id", "key"]).withColumns({"back": back, "ahead": ahead}))
    documents = written(documents.filter("total != 0 and invoice_day is not null").dropDuplicates(["invoice_id"]))
    edges = written(claims(asked, documents))
    roots = components(edges)
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = alone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    days = F.unix_date("day")
    p = asked.select((F.col("payment_id") * 4).alias("node"), F.col("payment_id").alias("id"), "key", (days - F.col("back")).cast("long").alias("lo"), (days + F.col("ahead")).cast("long").alias("hi"), days.cast("long").alias("day"), _cents("due").alias("cents"), "card", "by_label", F.lit(True).alias("fresh"))
    d = documents.select((F.col("invoice_id") * 4 + 1).alias("node"), F.col("invoice_id").alias("id"), "key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.unix_date("invoice_day").cast("long").alias("day"), _cents("total").alias("cents"), F.lit(False).alias("card"), F.lit(False).alias("by_label"), "fresh")
    rows = written(p.unionByName(d).join(placed, "node").withColumn("paying", F.col("node") % 4 == 0))
    parts = max(1, math.ceil(rows.count() / SETTLED_ROWS))
    return rows.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts))).groupBy("part").applyInPandas(_settled, "payment_id long, invoice_id long")


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, component in rows.sort_values("root", kind="stable").groupby("root", sort=False):
        out += _in_order(component)
    return pd.DataFrame(out, columns=["payment_id", "invoice_id"])


class _Free:
    """Places, from 1, of documents sorted by day; those that are taken are skipped in few steps, whichever way one walks."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.days: list[int] = []
        self.down, self.up = [0], [0, 1]

    def add(self, row: tuple) -> int:
        self.rows.append(row)
        self.days.append(row[0])
        self.down.append(len(self.rows))
        self.up.append(len(self.rows) + 1)
        return len(self.rows)

    def take(self, place: int) -> None:
        self.down[place], self.up[place] = place - 1, place + 1

    def _walk(self, to: list[int], at: int, step: int, last: int, most: int) -> list[tuple]:
        out = []
        while len(out) < most:
            while to[at] != at:
                to[at] = to[to[at]]
                at = to[at]
            if not 1 <= at <= len(self.rows) or (self.days[at - 1] - last) * step > 0:
                break
            out.append(self.rows[at - 1])
            at += step
        return out

    def latest(self, lo: int, hi: int, most: int) -> list[tuple]:
        """The ``most`` last from ``lo`` to ``hi``, the last first."""
        return self._walk(self.down, bisect.bisect_right(self.days, hi), -1, lo, most)

    def earliest(self, lo: int, hi: int, most: int) -> list[tuple]:
        return self._walk(self.up, bisect.bisect_left(self.days, lo) + 1, 1, hi, most)


def _sets(pool: list[tuple], due: int):
    """Every set of two to four of ``pool`` whose cents are ``due``: its last two, and none, one or two before them that have the rest."""
    before: dict[int, list[tuple]] = {0: [()]}
    for k, d in enumerate(pool):
        for last in pool[k + 1 :]:
            for c in before.get(due - d[2] - last[2], ()):
                yield *c, d, last
        for c in [(d,), *((e, d) for e in pool[:k])]:
            before.setdefault(sum(e[2] for e in c), []).append(c)


def _in_order(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """One component, payment after payment. A payment looks at two documents of its amount on either side of its day and at the
    ``SEARCHED`` latest fresh ones, however many its window holds."""
    equals, fresh_of, places = defaultdict(_Free), defaultdict(_Free), {}
    for key, day, id_, cents, fresh in sorted(rows.loc[~rows.paying, ["key", "day", "id", "cents", "fresh"]].itertuples(index=False, name=None)):
        d = day, id_, cents, fresh
        mine = [equals[key, cents], *([fresh_of[key]] if fresh else [])]
        places[id_] = [(of, of.add(d)) for of in mine]
    asked: dict = {}
    for p in rows.loc[rows.paying, ["card", "day", "id", "key", "lo", "hi", "cents", "by_label"]].itertuples(index=False, name=None):
        asked.setdefault((not p[0], p[1], p[2]), []).append(p)
    out = []
    for order, named in sorted(asked.items()):
        card, day, due, unsure = not order[0], order[1], named[0][6], any(p[7] for p in named)
        windows = sorted((key, lo, hi) for _, _, _, key, lo, hi, _, _ in named)
        near = [d for key, lo, hi in windows if (of := equals.get((key, due))) for d in of.latest(lo, min(day, hi), 2) + of.earliest(max(day + 1, lo), hi, 2)]
        equal = sorted((abs(day - d[0]), d[1], d[3]) for d in near)
        found = []
        if len(equal) == 1:
            found = [equal[0][1]] if equal[0][2] and not unsure else []
        elif equal:
            found = [equal[0][1]] if card and equal[0][0] < equal[1][0] else []
        elif not unsure:
            pools = (of.latest(lo, hi, SEARCHED) for key, lo, hi in windows if (of := fresh_of.get(key)))
            sets = (c for pool in pools for c in _sets(pool, due))
            some = list(itertools.islice(sets, 2))
            found = [d[1] for d in some[0]] if len(some) == 1 else []
        for i in found:
            for of, place in places[i]:
                of.take(place)
        out += [(order[2], i) for i in found]
    return out
