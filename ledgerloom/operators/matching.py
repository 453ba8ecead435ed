"""Payments and the invoices they pay: candidates by window and amount, tiers, sums, greedy passes."""

from __future__ import annotations

import functools
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.scratch import written
from ledgerloom.sources.ship import ship

#: Days before and after a payment in which its invoice may lie, and of a credit its document.
CARD, OTHER, CREDIT = (3, 1), (180, 0), (180, 90)
#: How far the month's invoice may be and how much farther the next; how near a misread total; how many invoices are
#: searched for sums, and how many options are shown.
MONTH, MARGIN, NEAR, SEARCHED, OPTIONS = 35, 20, "0.05", 12, 5
BUCKET = 32


def _apart(df: DataFrame) -> DataFrame:
    """A side that is never broadcast: sizes of stored tables are guessed from their compressed files, and what is exploded from them
    can be a hundred times that."""
    return df.hint("merge")


def _buckets(day, back, ahead):
    return F.explode(F.sequence(F.floor((F.unix_date(day) - back) / BUCKET), F.floor((F.unix_date(day) + ahead) / BUCKET)))


def _within(payments: DataFrame, invoices: DataFrame, *keys: str) -> DataFrame:
    """Pairs equal in ``keys`` whose invoice lies from ``back`` days before to ``ahead`` days after the payment (its columns): an
    equi-join on keys and bucket of days."""
    p = payments.withColumn("__b", _buckets(F.col("day"), F.col("back"), F.col("ahead")))
    i = invoices.withColumn("__b", F.floor(F.unix_date("invoice_day") / BUCKET))
    others = [c for c in i.columns if c in keys or c not in p.columns or c == "__b"]
    met = p.join(_apart(i.select(*others)), [*keys, "__b"]).drop("__b")
    return met.filter((F.datediff("day", "invoice_day") <= F.col("back")) & (F.datediff("invoice_day", "day") <= F.col("ahead")))


def in_window(payments: DataFrame, invoices: DataFrame, key: str = "key", back: int = OTHER[0], ahead: int = OTHER[1]) -> DataFrame:
    """Invoices of a payment's ``key`` inside its window of days: an equi-join on key and bucket of days, so a key with many
    rows meets only its neighbours in time."""
    p = payments.withColumn("__b", _buckets(F.col("day"), back, ahead))
    i = invoices.withColumn("__b", F.floor(F.unix_date("invoice_day") / BUCKET))
    near = p.join(_apart(i), [key, "__b"]).drop("__b")
    return near.filter((F.col("invoice_day") >= F.date_sub("day", back)) & (F.col("invoice_day") <= F.date_add("day", ahead)))


def exact(payments: DataFrame, invoices: DataFrame, key: str = "key") -> DataFrame:
    """Candidates inside the window whose total is the payment's, to the cent."""
    return in_window(payments, invoices, key).filter(F.col("total") == F.col("due"))


def tiers(candidates: DataFrame) -> DataFrame:
    """One row a payment: its nearest candidate, and how sure it is. A lone candidate is sure; of several the nearest is
    near-sure if it is at most 35 days off and the next at least 20 days further; all else is to be confirmed."""
    age = F.datediff("day", "invoice_day").alias("age")
    near = Window.partitionBy("payment_id").orderBy("age", "invoice_id")
    rows = candidates.select("payment_id", "invoice_id", age).withColumn("n", F.count("*").over(Window.partitionBy("payment_id")))
    rows = rows.withColumn("next", F.lead("age").over(near)).withColumn("r", F.row_number().over(near)).filter("r = 1")
    tier = F.when(F.col("n") == 1, "sure").when((F.col("age") <= 35) & (F.col("next") - F.col("age") >= 20), "near_sure").otherwise("to_confirm")
    return rows.select("payment_id", "invoice_id", "age", F.col("n").alias("n_candidates"), tier.alias("tier"))


def latest_before(payments: DataFrame, invoices: DataFrame, latest: int = SEARCHED) -> DataFrame:
    """Each payment with the ``latest`` newest invoices of its key in its window (of columns ``back`` and ``ahead``, or of months):
    invoices are numbered by day, one sorted pass finds the number of the last one in reach, and an equi-join on key and number
    brings that and those before it. However many a key has, a payment meets no more than ``latest``."""
    p = payments if "back" in payments.columns else payments.withColumns({"back": F.lit(OTHER[0]), "ahead": F.lit(OTHER[1])})
    order = Window.partitionBy("key").orderBy("invoice_day", "invoice_id")
    numbered = invoices.filter("invoice_day is not null").withColumn("__n", F.row_number().over(order))
    marks = p.select("key", "payment_id", F.date_add("day", F.col("ahead").cast("int")).alias("__d"), F.lit(None).cast("int").alias("__n")).unionByName(numbered.select("key", F.lit(None).cast("long").alias("payment_id"), F.col("invoice_day").alias("__d"), "__n"))
    upto = Window.partitionBy("key").orderBy("__d", F.col("payment_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = marks.withColumn("__last", F.max("__n").over(upto)).filter("payment_id is not null and __last is not null").select("payment_id", "key", "__last")
    asked = p.join(_apart(last), ["payment_id", "key"]).withColumn("__n", F.explode(F.sequence(F.greatest(F.col("__last") - latest + 1, F.lit(1)), F.col("__last"))))
    met = asked.join(_apart(numbered), ["key", "__n"]).filter(F.col("invoice_day") >= F.date_sub("day", F.col("back").cast("int")))
    return met.drop("__n", "__last")


def sums_of(items: Column, due: Column) -> Column:
    """Of ``items`` (array of struct<id, cents>) every set of two to four whose cents are ``due``: array of arrays of ids, smaller
    sets first. At most 781 sets of a dozen, in arrays."""
    start = F.transform(items, lambda x, i: F.struct(x["cents"].alias("sum"), F.array(x["id"]).alias("ids"), i.alias("last")))

    def longer(sets: Column) -> Column:
        after = lambda s: F.slice(items, s["last"] + 2, F.size(items))
        return F.flatten(F.transform(sets, lambda s: F.transform(after(s), lambda x, j: F.struct((s["sum"] + x["cents"]).alias("sum"), F.concat(s["ids"], F.array(x["id"])).alias("ids"), (s["last"] + 1 + j).alias("last")))))

    two = longer(start)
    three = longer(two)
    return F.transform(F.filter(F.concat(two, three, longer(three)), lambda s: s["sum"] == due), lambda s: s["ids"])


def _sums(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, sums) of payments that two to four of their ``SEARCHED`` newest invoices add up to."""
    cents = lambda c: (F.col(c) * 100).cast("long")
    lists = latest_before(payments, invoices).groupBy("payment_id").agg(F.first(cents("due")).alias("due"), F.array_sort(F.collect_list(F.struct(F.col("invoice_id").alias("id"), cents("total").alias("cents")))).alias("all"))
    return lists.select("payment_id", sums_of(F.col("all"), F.col("due")).alias("sums")).filter(F.size("sums") > 0)


def subset_sums(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, n_sums, smallest): how many sums of two to four of the latest invoices in the window give the payment, and of
    how many invoices the smallest is."""
    return _sums(payments, invoices).select("payment_id", F.size("sums").cast("long").alias("n_sums"), F.size(F.get("sums", F.lit(0))).cast("long").alias("smallest"))


# ---- the whole cascade -----------------------------------------------------------------------------------------------


def _found(rows: DataFrame, rule: Column | str, tier: Column | str, n: Column, first: Column) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("payment_id", text(rule).alias("rule"), text(tier).alias("tier"), F.least(n, F.lit(OPTIONS)).cast("long").alias("n_options"), first.cast("string").alias("first"))


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each payment by ``order``, with how many there are (``n``) and the next one's ``age``."""
    w = Window.partitionBy("payment_id").orderBy(*order)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("payment_id"))).withColumn("next", F.lead("age").over(w))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1")


def _dated(near: DataFrame) -> DataFrame:
    return near.withColumn("age", F.abs(F.datediff("day", "invoice_day")))


def cascade(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, rule, tier, n_options, first): what each payment paid, by the first rule that answers; without one no row.

    ``payments``: payment_id, key, day, due, card; ``invoices``: invoice_id, key, invoice_day (null: not read), total. Named
    invoices are those of the payment's key. A card reaches few days, anything else months back. In this order: one exact total,
    or by card the strictly nearest of several (sure); several, near-sure where the nearest is the month's; one sum of two to four
    (sure) or several; totals within a tenth, near-sure where one alone is within ``NEAR``; by card an undated total within a
    cent; by card the same total of anybody. Every step works on what the ones before left, each by an equi-join.
    """
    card = F.col("card")
    reach = payments.filter("due > 0").withColumns({"back": F.when(card, CARD[0]).otherwise(OTHER[0]), "ahead": F.when(card, CARD[1]).otherwise(OTHER[1])})
    invoices = invoices.filter("total != 0")
    dated = invoices.filter("invoice_day is not null")
    near = lambda p, i, *keys: _dated(_within(p, i, *keys))
    left = lambda p, *found: functools.reduce(lambda a, f: a.join(_apart(f.select("payment_id")), "payment_id", "left_anti"), found, p)

    x = _ranked(near(reach.withColumn("total", F.col("due")), dated, "key", "total"), "age", "invoice_id")
    one = (F.col("n") == 1) | (card & (F.col("age") < F.col("next")))
    tier = F.when(one, "sure").when((F.col("age") <= MONTH) & (F.col("next") - F.col("age") >= MARGIN), "near_sure").otherwise("to_confirm")
    exact_ = written(_found(x, F.when(F.col("n") == 1, "exact").when(one, "nearest").otherwise("several"), tier, F.when(one, 1).otherwise(F.col("n")), F.col("invoice_id")))

    open_ = written(left(reach, exact_))
    ids = F.array_join(F.transform(F.array_sort(F.get("sums", F.lit(0))), lambda i: i.cast("string")), "+")
    lone = F.size("sums") == 1
    sums = written(_found(_sums(open_, dated), F.when(lone, "sum").otherwise("sums"), F.when(lone, "sure").otherwise("to_confirm"), F.size("sums"), F.when(lone, ids).otherwise("")))

    open_ = written(left(open_, sums))
    # A total within a tenth lies in the payment's band of a tenth or in one of its neighbours.
    band = lambda c: F.floor(F.ln(F.col(c).cast("double")) / math.log(1.1))
    close = near(open_.withColumn("band", F.explode(F.array(*(band("due") + i for i in (-2, -1, 0, 1, 2))))), dated.filter("total > 0").withColumn("band", band("total")), "key", "band")
    close = close.withColumn("gap", F.abs(F.col("total") - F.col("due"))).filter(F.col("gap") <= F.col("due") * F.lit("0.10").cast("decimal(3,2)"))
    close = close.withColumn("within", F.count_if(F.col("gap") <= F.lit(NEAR).cast("decimal(3,2)")).over(Window.partitionBy("payment_id")))
    sure = (F.col("within") == 1) & (card | (F.col("age") <= MONTH))
    closest = written(_found(_ranked(close, "gap", "age", "invoice_id"), "close", F.when(sure, "near_sure").otherwise("to_confirm"), F.col("n"), F.col("invoice_id")))

    open_ = written(left(open_, closest).filter(card))
    cents = lambda c: (F.col(c) * 100).cast("long")
    undated = open_.withColumn("cent", F.explode(F.array(*(cents("due") + i for i in (-1, 0, 1))))).join(_apart(invoices.filter("invoice_day is null").withColumn("cent", cents("total"))), ["key", "cent"])
    undated = undated.withColumn("gap", F.abs(F.col("total") - F.col("due"))).withColumn("age", F.lit(0))
    unread = _found(_ranked(undated, "gap", "invoice_id"), "undated", "to_confirm", F.col("n"), F.col("invoice_id"))

    # Anybody's: invoices are counted by total and day first, so that a payment meets a row for each day of its few.
    days = dated.groupBy("total", "invoice_day").agg(F.count("*").alias("m"), F.min("invoice_id").alias("invoice_id"))
    asked = left(open_, unread).withColumn("total", F.col("due")).withColumn("invoice_day", F.explode(F.sequence(F.date_sub("day", CARD[0]), F.date_add("day", CARD[1]))))
    same = _dated(asked.join(_apart(days), ["total", "invoice_day"]))
    same = same.withColumn("all", F.sum("m").over(Window.partitionBy("payment_id")))
    unnamed = _found(_ranked(same, "age", "invoice_id"), "unnamed", "to_confirm", F.col("all"), F.col("invoice_id"))
    return exact_.unionByName(sums).unionByName(closest).unionByName(unread).unionByName(unnamed)


def credit_cascade(credits: DataFrame, documents: DataFrame) -> DataFrame:
    """(payment_id, rule, tier, n_options, first): the sales documents that each credit paid, by the first rule that answers.

    ``credits``: payment_id, key, day, due (the amount), by_label (its payer is known by the label alone), recognised (something
    else explains it); ``documents``: invoice_id, key, invoice_day, total (what is still due), fresh (nothing paid yet).
    Documents from half a year before the credit to three months after it are in reach. In this order: one exact balance, sure
    where fresh and near-sure where paid in part; several; one sum of fresh ones (sure) or several; within ``NEAR`` (near-sure if
    alone); any larger balance, of which the credit may be a deposit, the nearest first; the same balance of anybody, for what
    is not recognised. A payer known by the label is never surer than near-sure.

    Equal credits of a key (for anybody's documents: of all) and equal documents of a key and day are looked at once; what a
    credit's documents come to is one aggregate over them, and every document in reach counts.
    """
    reach = credits.filter("due > 0").withColumns({"back": F.lit(CREDIT[0]), "ahead": F.lit(CREDIT[1])})
    documents = documents.filter("total > 0 and invoice_day is not null")
    same_day = documents.groupBy("key", "invoice_day", "total", "fresh").agg(F.count("*").alias("m"), F.min("invoice_id").alias("invoice_id"))
    met = _dated(_within(reach.select("key", "day", "due", "back", "ahead").distinct(), same_day, "key")).withColumn("gap", F.abs(F.col("total") - F.col("due")))
    kinds = {"exact": (F.col("gap") == 0, ("age", "invoice_id", "fresh")), "close": (F.col("gap") <= F.lit(NEAR).cast("decimal(3,2)"), ("gap", "age", "invoice_id")), "larger": (F.col("total") > F.col("due"), ("age", "invoice_id"))}
    counts = [F.sum(F.when(on, F.col("m"))).alias(f"n_{k}") for k, (on, _) in kinds.items()]
    firsts = [F.min(F.when(on, F.struct(*order))).alias(k) for k, (on, order) in kinds.items()]
    rows = written(reach.join(_apart(met.groupBy("key", "day", "due").agg(*counts, *firsts)), ["key", "day", "due"], "left"))
    sums = _sums(rows.filter("n_exact is null").select(*reach.columns), documents.filter("fresh"))
    rows = written(rows.join(_apart(sums), "payment_id", "left"))

    lone = F.size("sums") == 1
    ids = F.array_join(F.transform(F.array_sort(F.get("sums", F.lit(0))), lambda i: i.cast("string")), "+")
    answer = lambda rule, tier, n, first: F.struct(F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), F.lit(tier).alias("tier") if isinstance(tier, str) else tier.alias("tier"), n.cast("long").alias("n"), first.cast("string").alias("first"))
    sure = F.when(F.col("by_label"), "near_sure").otherwise("sure")
    one, fresh = F.col("n_exact") == 1, F.col("exact.fresh")
    exact_ = answer(F.when(one & fresh, "exact").when(one, "balance").otherwise("several"), F.when(one & fresh, sure).when(one, "near_sure").otherwise("to_confirm"), F.col("n_exact"), F.col("exact.invoice_id"))
    summed = answer(F.when(lone, "sum").otherwise("sums"), F.when(lone, sure).otherwise("to_confirm"), F.size("sums"), F.when(lone, ids).otherwise(""))
    closest = answer("close", F.when(F.col("n_close") == 1, "near_sure").otherwise("to_confirm"), F.col("n_close"), F.col("close.invoice_id"))
    deposit = answer("deposit", "to_confirm", F.col("n_larger"), F.col("larger.invoice_id"))
    found = F.when(F.col("n_exact").isNotNull(), exact_).when(F.col("sums").isNotNull(), summed).when(F.col("n_close").isNotNull(), closest).when(F.col("n_larger").isNotNull(), deposit)
    rows = rows.withColumn("found", found)
    named = _found(rows.filter("found is not null"), F.col("found.rule"), F.col("found.tier"), F.col("found.n"), F.col("found.first"))

    days = documents.groupBy("total", "invoice_day").agg(F.count("*").alias("m"), F.min("invoice_id").alias("invoice_id"))
    open_ = rows.filter("found is null and not recognised")
    return named.unionByName(_found(_anybodys(open_, days), "unnamed", "to_confirm", F.col("all"), F.col("one.invoice_id")))


def _anybodys(credits: DataFrame, days: DataFrame) -> DataFrame:
    """``credits`` with the documents of just their amount in reach, whoever's: how many (``all``), and the nearest (``one``: age,
    invoice_id). ``days`` has them by total and day (m, invoice_id); equal amounts of a day are looked up once and aggregated."""
    asked = credits.select("day", "due", "back", "ahead").distinct().withColumn("total", F.col("due"))
    met = _dated(_within(asked, days, "total")).groupBy("day", "due").agg(F.sum("m").alias("all"), F.min(F.struct("age", "invoice_id")).alias("one"))
    return credits.join(_apart(met), ["day", "due"])


# ---- one after another -----------------------------------------------------------------------------------------------

#: Rows of one group of islands, about.
GREEDY_ROWS = 50_000


def greedy(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, invoice_id): payments in order, cards first, then by day and id, each linked to the exact named total that it is
    sure of among those no earlier one took: the only one, or by card the strictly nearest.

    Totals are equal to the cent, so payments of different amounts never compete: links fall apart by key and amount, and again
    where no link spans the days between. An island goes through one task whole, many small ones together; only one key paying
    one amount again and again without half a year's pause makes a large one.
    """
    reach = payments.filter("due > 0").withColumns({"back": F.when(F.col("card"), CARD[0]).otherwise(OTHER[0]), "ahead": F.when(F.col("card"), CARD[1]).otherwise(OTHER[1])})
    links = _dated(_within(reach.withColumn("total", F.col("due")), invoices.filter("total != 0 and invoice_day is not null"), "key", "total"))
    links = links.select("key", "total", "payment_id", "card", "day", "invoice_id", "age", F.least("day", "invoice_day").alias("a"), F.greatest("day", "invoice_day").alias("b"))
    w = Window.partitionBy("key", "total").orderBy("a", "b", "payment_id", "invoice_id")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    links = links.withColumn("new", (before.isNull() | (F.col("a") > before)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        rows = rows.sort_values(["card", "day", "payment_id", "age", "invoice_id"], ascending=[False, True, True, True, True])
        for payment, mine in itertools.groupby(zip(rows.payment_id.tolist(), rows.card.tolist(), rows.age.tolist(), rows.invoice_id.tolist(), strict=True), key=lambda r: r[0]):
            free = [(age, i, card) for _, card, age, i in mine if i not in taken]
            if len(free) == 1 or len(free) > 1 and free[0][2] and free[0][0] < free[1][0]:
                taken.add(free[0][1])
                out.append((payment, free[0][1]))
        return pd.DataFrame(out, columns=["payment_id", "invoice_id"])

    ship(payments.sparkSession)
    rows = written(links.select("key", "total", "island", "payment_id", "card", "day", "age", "invoice_id"))
    groups = max(1, math.ceil(rows.count() / GREEDY_ROWS))
    return rows.withColumn("part", F.pmod(F.xxhash64("key", "total", "island"), F.lit(groups))).groupBy("part").applyInPandas(take, "payment_id long, invoice_id long")


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping intervals of a key made one: (key, start, end, n)."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__reach", F.max(end).over(before)).withColumn("__new", (F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))).cast("int"))
    rows = rows.withColumn("__i", F.sum("__new").over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__i")
