"""A store's list as of any day: what was known then, scored then, for many days at once.

Every figure of a day is a running sum or a last row up to it. So running sums are taken once, a point in time is looked up by
one sorted pass over marks and questions of a key, and what lies between two points is a difference: a replayed visit costs a
few rows however long its history is.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import forecast as fc
from ledgerloom.sources.scratch import written

#: Days of till looked back, of coverage that lags, of a pause, of what is new and of a year; gaps of the usual one
#: and what it is without; purchases that are elsewhere; what is given back of a deposit; visits not to insist beyond.
TILL_WINDOW, STALE, PAUSE, NEW, YEAR = 365, 3, 30, 90, 365
GAPS, DEFAULT_GAP, ELSEWHERE, DEPOSIT = 30, 14.0, 3, 0.5
LIFTED, HABIT = 3, 5


@dataclass(frozen=True)
class Season:
    """``today``, the till's first day, the last day it covers (null: no till), and the last day it could cover."""

    today: date
    till_start: date | None
    covered_until: date | None
    ref_day: date


def as_of(asked: DataFrame, marks: DataFrame, keys: list[str], points: dict[str, Column]) -> DataFrame:
    """``asked`` with a struct for each of ``points``: the last of ``marks`` (keys, day, ...) of the same keys before that day,
    null where there is none. One sorted pass a key over the marks and the distinct points."""
    value = F.struct("day", *(c for c in marks.columns if c not in (*keys, "day")))
    rows = asked
    for name, day in points.items():
        rows = rows.withColumn(f"__{name}", day)
    at = rows.select(*keys, F.explode(F.array(*(F.col(f"__{n}") for n in points))).alias("__d")).filter("__d is not null").distinct()
    both = marks.select(*keys, F.col("day").alias("__d"), F.lit(True).alias("__mark"), value.alias("__v"))
    both = both.unionByName(at.select(*keys, "__d", F.lit(False).alias("__mark"), F.lit(None).cast(both.schema["__v"].dataType).alias("__v")))
    # A question comes before its own day's mark.
    upto = Window.partitionBy(*keys).orderBy("__d", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    found = written(both.withColumn("__v", F.last("__v", ignorenulls=True).over(upto)).filter("not __mark").select(*keys, "__d", "__v"))
    for name in points:
        rows = rows.join(found.select(*keys, F.col("__d").alias(f"__{name}"), F.col("__v").alias(name)), [*keys, f"__{name}"], "left").drop(f"__{name}")
    return rows


def _grown(day: Column, half_life: float, season: Season) -> Column:
    """A weight that doubles every ``half_life`` days; sums of it, scaled back, decay."""
    return F.pow(F.lit(2.0), F.datediff(day, F.lit(season.today)) / half_life)


def _geometric(n: Column) -> Column:
    d = 0.5 ** (1 / fc.HALF_LIFE)
    return (1 - F.pow(F.lit(d), n)) / (1 - d)


def _history(buys: DataFrame, season: Season) -> DataFrame:
    w = Window.partitionBy("article").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    per = buys.groupBy("article", "day").agg(F.sum("quantity").cast("double").alias("q"))
    grown = F.col("q") * _grown(F.col("day"), fc.HALF_LIFE, season)
    return per.select("article", "day", F.row_number().over(w).alias("n"), F.sum("q").over(run).alias("qty"), F.sum(grown).over(run).alias("ew"), "q", F.first("day").over(run).alias("first"), F.lag("day", ELSEWHERE - 1).over(w).alias("third"), F.lead("day").over(w).alias("next"))


def _visits(visits: DataFrame, season: Season) -> DataFrame:
    w = Window.partitionBy("store").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    days = visits.select("store", "day").distinct().withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    gaps = F.array_sort(F.collect_list("gap").over(w.rowsBetween(1 - GAPS, 0)))
    half = lambda g: (F.get(g, F.floor((F.size(g) - 1) / 2).cast("int")) + F.get(g, F.floor(F.size(g) / 2).cast("int"))) / 2.0
    days = days.withColumn("gaps", gaps).withColumn("w", F.sum(_grown(F.col("day"), fc.MEMORY_DAYS, season)).over(run))
    return days.select("store", "day", "w", F.when(F.size("gaps") >= 2, half(F.col("gaps"))).otherwise(DEFAULT_GAP).alias("usual_gap"))


def _till(sold: DataFrame, season: Season) -> DataFrame:
    run = Window.partitionBy("article").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    per = sold.groupBy("article", "day").agg(F.sum("quantity").cast("double").alias("q"))
    return per.select("article", "day", F.sum("q").over(run).alias("cum"), F.sum(F.col("q") * _grown(F.col("day"), fc.HALF_LIFE, season)).over(run).alias("ew"))


def scores(asked: DataFrame, buys: DataFrame, visits: DataFrame, sold: DataFrame, returned: DataFrame, season: Season) -> DataFrame:
    """``asked`` (store, article, day, stop) with what the list of that ``day`` says, knowing what is dated before ``stop``.

    ``buys``: store, article, day, quantity; ``visits``: store, day; ``sold`` (the till's) and ``returned``: article, day,
    quantity. Adds n_all, n_here, habit, need, ``clock`` (``till``: sold since the last purchase, and to come, at the ratio of
    bought to sold over the days that both series cover; else ``calendar``; null under three purchases), chance, ``status``
    (``ok``, ``deposit``, ``elsewhere``), last_day, last_here, first_day, usual_gap, still_sold. A pair that was not bought there
    before has no row; a till that lags more than ``STALE`` days goes on at its recent rate.
    """
    day, zero = F.col("day"), F.lit(0.0)
    covered = F.least(F.lit(season.covered_until).cast("date"), F.when(F.col("stop") <= day, F.date_sub("stop", 1)).otherwise(F.lit(date(9999, 1, 1)))) if season.covered_until else F.lit(None).cast("date")
    ref = F.when(F.col("stop") <= day, F.least(F.lit(season.ref_day), F.date_sub("stop", 1))).otherwise(F.lit(season.ref_day))
    till_start = F.when(F.lit(season.till_start).cast("date") < day, F.lit(season.till_start).cast("date")) if season.till_start else F.lit(None).cast("date")
    rows = asked.withColumns({"covered": covered, "fresh": F.coalesce(F.datediff(ref, covered) <= STALE, F.lit(False)), "start": F.when(till_start.isNotNull(), F.greatest(till_start, F.date_sub("day", TILL_WINDOW)))})
    rows = rows.withColumn("end", F.least(day, F.date_add("covered", 1)))

    history = written(_history(buys, season))
    rows = as_of(rows, history, ["article"], {"all": F.col("stop"), "then": day, "low": F.col("start"), "high": F.col("end")}).filter(F.col("all").isNotNull())
    run = Window.partitionBy("store", "article").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    here = buys.select("store", "article", "day").distinct().select("store", "article", "day", F.count("*").over(run).alias("n"), F.sum(_grown(day, fc.MEMORY_DAYS, season)).over(run).alias("w"))
    rows = as_of(rows, here, ["store", "article"], {"here": F.col("stop")}).filter(F.col("here").isNotNull())
    rows = as_of(rows, written(_visits(visits, season)), ["store"], {"seen": F.col("stop"), "before": F.col("all.first")})
    back = _grown(day, fc.MEMORY_DAYS, season)
    since = (F.coalesce("seen.w", zero) - F.coalesce("before.w", zero)) / back
    habit = (F.col("here.w") / back + fc.PRIOR_VISITS * fc.PRIOR_CHANCE) / (since + fc.PRIOR_VISITS)

    given = returned.groupBy("article", "day").agg(F.sum("quantity").cast("double").alias("q"))
    given = given.select("article", "day", F.sum("q").over(Window.partitionBy("article").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    rows = as_of(rows, given, ["article"], {"given": F.col("stop")})
    low_day = F.coalesce("low.next", F.when(F.col("low").isNull(), F.col("all.first")))
    rows = rows.withColumns({"low_day": low_day, "high_day": F.col("high.day"), "last_day": F.col("all.day"), "pause": F.date_sub("end", PAUSE)})
    points = {f"t_{p}": F.col(p) for p in ("day", "start", "end", "low_day", "high_day", "last_day", "pause")}
    rows = written(as_of(rows, written(_till(sold, season)), ["article"], points).withColumns({"habit": habit, "usual_gap": F.coalesce("seen.usual_gap", F.lit(DEFAULT_GAP))}))

    cum = lambda p: F.coalesce(f"t_{p}.cum", zero)
    ew = lambda p: F.coalesce(f"t_{p}.ew", zero)
    # What is dated in [a, b): a difference; nothing where b is not after a.
    between = lambda a, b: F.when(F.col(b) > F.col(a), cum(b) - cum(a)).otherwise(0.0)
    rate_to = lambda last: (ew(last) - ew("start")) * F.pow(F.lit(0.5), (F.datediff(F.col(last), F.lit(season.today)) - 1) / fc.HALF_LIFE) / _geometric(F.datediff(F.col(last), "start"))
    days_in = lambda last: F.coalesce(F.when(F.datediff(F.col(last), "start") > 0, rate_to(last)), zero)
    n_all, last_qty = F.col("all.n"), F.col("all.q")
    n_low, n_high = F.coalesce("low.n", F.lit(0)), F.coalesce("high.n", F.lit(0))
    poured = between("low_day", "high_day")
    ratio = F.try_divide(F.col("high.qty") - F.col("high.q") - F.coalesce("low.qty", zero), poured)
    ahead = F.greatest(F.datediff("day", F.greatest("end", "last_day")), F.lit(0))
    rate = F.when(F.col("fresh"), days_in("day")).otherwise(days_in("end"))
    since_last = F.when(F.col("fresh"), between("last_day", "day")).otherwise(between("last_day", "end") + days_in("end") * ahead)
    applies = F.col("start").isNotNull() & F.col("end").isNotNull() & (cum("day") > 0) & (n_all - n_low >= fc.FEW) & (n_high - n_low >= fc.FEW) & (poured > 0) & (last_qty > 0)
    applies &= (ratio >= fc.RATIO_LOW) & (ratio <= fc.RATIO_HIGH)
    by_till = ratio * (F.greatest(since_last, zero) + rate * F.col("usual_gap")) / last_qty
    # The calendar's rate: purchases from the first to the day before.
    n_days = F.datediff(day, F.col("all.first"))
    daily = F.when(n_days > 0, F.coalesce("then.ew", zero) * F.pow(F.lit(0.5), (F.datediff("day", F.lit(season.today)) - 1) / fc.HALF_LIFE) / _geometric(n_days))
    by_calendar = F.when((daily != 0) & (last_qty > 0), (F.datediff("day", "last_day") + F.col("usual_gap")) / (last_qty / daily))
    few = n_all < fc.FEW
    need = F.when(few, F.lit(None).cast("double")).when(applies, by_till).otherwise(by_calendar)
    clock = F.when(few | need.isNull(), F.lit(None).cast("string")).when(applies, "till").otherwise("calendar")
    given = F.coalesce("given.cum", zero)
    status = F.when((given > 0) & (F.col("all.qty") > 0) & (given >= DEPOSIT * F.col("all.qty")), "deposit").when((n_all >= ELSEWHERE) & (F.col("here.day") < F.col("all.third")), "elsewhere").otherwise("ok")
    still = F.col("end").isNotNull() & (cum("day") > 0) & (between("pause", "end") > 0)
    out = rows.select(
        "store", "article", "day", "stop", n_all.alias("n_all"), F.col("here.n").alias("n_here"), "habit", need.alias("need"), clock.alias("clock"), few.alias("few"), status.alias("status"),
        "last_day", F.col("here.day").alias("last_here"), F.col("all.first").alias("first_day"), "usual_gap", still.alias("still_sold"),
    )
    return out.withColumn("chance", fc.chance(F.col("habit"), F.coalesce("need", F.lit(1.0)), F.col("few"))).drop("few")


def last_visits(visits: DataFrame, season: Season, n: int = HABIT) -> DataFrame:
    """(store, day, r): each store's ``n`` latest visits up to today, the latest first."""
    days = visits.filter(F.col("day") <= F.lit(season.today)).select("store", "day").distinct()
    return days.withColumn("r", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("day")))).filter(F.col("r") <= n)


def replayed(listed: DataFrame, buys: DataFrame, visits: DataFrame, sold: DataFrame, returned: DataFrame, season: Season) -> DataFrame:
    """``scores`` of each of ``listed`` (store, article) on the morning of each of the store's last visits, with the visit's ``r``
    and whether the article was ``bought`` then; visits on which it had never been bought there have no row."""
    recent = written(last_visits(visits, season))
    asked = listed.select("store", "article").join(recent, "store")
    past = scores(asked.select("store", "article", "day", F.col("day").alias("stop")), buys, visits, sold, returned, season)
    bought = buys.select("store", "article", "day").distinct().withColumn("bought", F.lit(True))
    return past.join(recent, ["store", "day"]).join(bought, ["store", "article", "day"], "left").withColumn("bought", F.coalesce("bought", F.lit(False)))


def plan(buys: DataFrame, visits: DataFrame, sold: DataFrame, returned: DataFrame, season: Season) -> DataFrame:
    """Every article that a store ever sold us with today's ``scores``, ``insisted`` (how many visits in a row it was listed and
    not bought, where that is enough to stop insisting), ``silent`` (``dropped``, or ``paused`` where the till still sells it) and
    ``section``: ``buy``, ``maybe`` (half as likely, or insisted), ``new``, ``quiet``, ``elsewhere``, ``deposit``, null for none.

    What habit alone would list may be left ``HABIT`` times in a row, what need lifted onto the list ``LIFTED`` times. Rows after
    today do not count; empty tables give no rows.
    """
    upto = lambda df: df.filter(F.col("day") <= F.lit(season.today))
    buys, visits, sold, returned = (written(upto(df)) for df in (buys, visits, sold, returned))
    today = F.lit(season.today)
    pairs = buys.select("store", "article").distinct().withColumns({"day": today, "stop": F.date_add(today, 1)})
    now = written(scores(pairs, buys, visits, sold, returned, season))
    alone = 1 / (1 + F.exp(-(F.ln(F.col("habit") / (1 - F.col("habit"))) + fc.BIAS)))
    listed = now.filter((F.col("status") == "ok") & (F.col("chance") >= fc.BUY_AT)).select("store", "article", F.when(alone < fc.BUY_AT, LIFTED).otherwise(HABIT).alias("k"))
    past = replayed(listed, buys, visits, sold, returned, season)
    again = past.join(listed, ["store", "article"]).filter("r <= k and not bought and status = 'ok'").filter(F.col("chance") >= fc.BUY_AT)
    insisted = again.groupBy("store", "article", "k").agg(F.count("*").alias("n")).filter("n = k").select("store", "article", F.col("k").alias("insisted"))
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("article").orderBy("day")))
    usual = buys.select("article", "day").distinct().withColumn("gap", gap).groupBy("article").agg(F.median("gap").alias("median_gap"))
    rows = now.join(insisted, ["store", "article"], "left").join(usual, "article", "left")
    quiet = (F.col("n_all") >= fc.FEW) & (F.col("median_gap") > 0) & (F.datediff("day", "last_day") > F.greatest(fc.DROP_FACTOR * F.col("median_gap"), F.lit(float(fc.DROP_DAYS)))) & (F.col("status") != "deposit")
    rows = rows.withColumn("silent", F.when(quiet, F.when(F.col("still_sold"), "paused").otherwise("dropped")))
    c, ok, year = F.col("chance"), F.col("status") == "ok", F.datediff("day", "last_here") <= YEAR
    section = (
        F.when(F.col("status") == "deposit", "deposit").when((F.col("status") == "elsewhere") & year, "elsewhere").when(ok & F.col("insisted").isNotNull(), "maybe").when(ok & (c >= fc.BUY_AT), "buy").when(ok & (c >= fc.MAYBE_AT), "maybe")
        .when(ok & (F.col("n_all") < fc.FEW) & (F.datediff("day", "first_day") <= NEW), "new").when(ok & F.col("silent").isNotNull() & year, "quiet")
    )
    return rows.withColumn("section", section).drop("stop", "day", "still_sold", "median_gap")
