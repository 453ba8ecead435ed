"""Queries over a store's list, today's and as it was on the morning of past visits, and over how far sources were searched."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import progress, replay
from ledgerloom.sources import views

from .registry import query

#: The till's month stands for ten, moved to where the ledger's purchases are; it lags two days.
SEASON = replay.Season(date(2000, 6, 30), date(1999, 9, 12), date(2000, 6, 28), date(2000, 6, 30))
LAST, TIMES = date(2024, 1, 30), 10
TYPES = ("view", "click", "error", "purchase", "signup")
STORES, KINDS = 4, 40


def _tables(spark, sf_dir):
    """Purchases, visits, what the till sold of each article (a twentieth of an event of its type), and what went back of every
    fifth. An article is one of the first brands, or a brand and a number."""
    brand = F.substring("article", 7, 10).cast("int")
    products = views.products(spark, sf_dir).select("product_id", brand.alias("brand"), F.when(brand <= 4, F.col("article")).otherwise(F.concat(F.col("article"), F.lit("/"), (F.col("product_id") % KINDS).cast("string"))).alias("article"))
    lines = views.lines(spark, sf_dir).join(products, "product_id").withColumn("quantity", F.col("quantity").cast("double"))
    buys = lines.filter("flag <> 'R'").select((F.col("supplier_id") % STORES).alias("store"), "article", "day", "quantity")
    returned = lines.filter("flag = 'R' and brand % 5 = 0").select("article", "day", "quantity")
    # A sixth of the brands is not in the till.
    articles = products.filter("brand % 6 <> 0").select("article", F.element_at(F.array(*map(F.lit, TYPES)), F.col("brand") % 5 + 1).alias("product")).distinct()
    day = F.date_sub(F.lit(SEASON.covered_until), F.datediff(F.lit(LAST), "day") * TIMES)
    sold = views.till_days(spark, sf_dir).join(articles, "product").select("article", day.alias("day"), (F.col("quantity") * 0.05).alias("quantity"))
    return buys, buys.select("store", "day"), sold, returned


TABLES = f"""
items AS (SELECT product_id, CAST(substr(article, 7) AS INT) AS brand, CASE WHEN CAST(substr(article, 7) AS INT) <= 4 THEN article ELSE article || '/' || product_id % {KINDS} END AS article FROM products), bought AS (SELECT supplier_id % {STORES} AS store, article, brand, day, flag, quantity FROM lines JOIN items USING (product_id) WHERE day <= DATE '2000-06-30'),
buys AS (SELECT store, article, day, CAST(sum(quantity) AS DOUBLE) AS q FROM bought WHERE flag <> 'R' GROUP BY 1, 2, 3), per AS (SELECT article, day, sum(q) AS q FROM buys GROUP BY 1, 2), vis AS (SELECT DISTINCT store, day FROM buys), ret AS (SELECT article, day, CAST(sum(quantity) AS DOUBLE) AS q FROM bought WHERE flag = 'R' AND brand % 5 = 0 GROUP BY 1, 2),
art AS (SELECT DISTINCT article, {list(TYPES)}[brand % 5 + 1] AS product FROM items WHERE brand % 6 <> 0), sold AS (SELECT article, DATE '2000-06-28' - CAST((DATE '{LAST}' - day) * {TIMES} AS INTEGER) AS day, quantity * 0.05 AS q FROM till_days JOIN art USING (product)),
recent AS (SELECT * FROM (SELECT store, day, row_number() OVER (PARTITION BY store ORDER BY day DESC) AS r FROM vis) AS v WHERE r <= 5), pairs AS (SELECT DISTINCT store, article FROM buys)
"""


def _scores(name: str, asked: str) -> str:
    """Scores of (store, article, day, stop) by their definitions, every sum over all its rows."""
    return f"""
{name}_x AS (SELECT *, least(day, covered + 1) AS stop_till, ref - covered <= 3 AS fresh, CASE WHEN DATE '1999-09-12' < day THEN greatest(DATE '1999-09-12', day - 365) END AS since FROM (SELECT *, least(DATE '2000-06-28', CASE WHEN stop <= day THEN stop - 1 ELSE DATE '9999-01-01' END) AS covered, CASE WHEN stop <= day THEN least(DATE '2000-06-30', stop - 1) ELSE DATE '2000-06-30' END AS ref FROM ({asked}) AS q) AS q),
{name}_h AS (SELECT x.store, x.article, x.day, stop, stop_till, fresh, since, count(*) AS n_all, max(p.day) AS last_day, arg_max(q, p.day) AS last_q, min(p.day) AS first_day, sum(q) AS qty, list_extract(list(p.day ORDER BY p.day DESC), 3) AS third, sum(q * pow(0.5, (x.day - 1 - p.day) / 90.0)) FILTER (WHERE p.day < x.day) AS ew,
  count(*) FILTER (WHERE p.day >= since) AS after_low, count(*) FILTER (WHERE p.day >= since AND p.day < stop_till) AS inside, min(p.day) FILTER (WHERE p.day >= since) AS low_day, max(p.day) FILTER (WHERE p.day < stop_till) AS high_day, sum(q) FILTER (WHERE p.day >= since AND p.day < stop_till) AS q_inside, arg_max(q, p.day) FILTER (WHERE p.day < stop_till) AS q_high
  FROM {name}_x x JOIN per p ON p.article = x.article AND p.day < stop GROUP BY ALL),
{name}_b AS (SELECT h.*, count(*) AS n_here, sum(pow(0.5, (h.day - b.day) / 180.0)) AS here, max(b.day) AS last_here FROM {name}_h h JOIN buys b ON b.store = h.store AND b.article = h.article AND b.day < stop GROUP BY ALL),
{name}_g AS (SELECT store, stop, CASE WHEN len(d) >= 3 THEN list_aggregate(list_transform(range(1, len(d)), lambda i: d[i] - d[i + 1]), 'median') ELSE 14.0 END AS gap FROM (SELECT q.store, stop, list_slice(list(v.day ORDER BY v.day DESC), 1, 31) AS d FROM (SELECT DISTINCT store, stop FROM {name}_x) AS q JOIN vis v ON v.store = q.store AND v.day < stop GROUP BY 1, 2) AS q),
{name}_v AS (SELECT b.*, gap, (here + 0.1) / (coalesce((SELECT sum(pow(0.5, (b.day - v.day) / 180.0)) FROM vis v WHERE v.store = b.store AND v.day >= b.first_day AND v.day < b.stop), 0) + 1) AS habit, coalesce((SELECT sum(r.q) FROM ret r WHERE r.article = b.article AND r.day < b.stop), 0) AS back FROM {name}_b b JOIN {name}_g USING (store, stop)),
{name}_t AS (SELECT v.store, v.article, v.day, v.stop, sum(q) AS ever, sum(q) FILTER (WHERE s.day >= low_day AND s.day < high_day) AS poured, sum(q) FILTER (WHERE s.day >= last_day) AS to_day, sum(q) FILTER (WHERE s.day >= last_day AND s.day < stop_till) AS to_end, sum(q) FILTER (WHERE s.day >= stop_till - 30 AND s.day < stop_till) AS lately,
  sum(q * pow(0.5, (v.day - 1 - s.day) / 90.0)) FILTER (WHERE s.day >= since) AS ew_day, sum(q * pow(0.5, (stop_till - 1 - s.day) / 90.0)) FILTER (WHERE s.day >= since AND s.day < stop_till) AS ew_end FROM {name}_v v JOIN sold s ON s.article = v.article AND s.day < v.day GROUP BY 1, 2, 3, 4),
{name}_k AS (SELECT v.*, ever, poured, lately, (q_inside - q_high) / nullif(poured, 0) AS k, coalesce(CASE WHEN fresh THEN ew_day / ((1 - pow(pow(0.5, 1 / 90.0), v.day - since)) / (1 - pow(0.5, 1 / 90.0))) WHEN stop_till > since THEN ew_end / ((1 - pow(pow(0.5, 1 / 90.0), stop_till - since)) / (1 - pow(0.5, 1 / 90.0))) END, 0) AS rate, coalesce(to_day, 0) AS to_day, coalesce(to_end, 0) AS to_end,
  CASE WHEN v.day > first_day THEN ew / ((1 - pow(pow(0.5, 1 / 90.0), v.day - first_day)) / (1 - pow(0.5, 1 / 90.0))) END AS daily FROM {name}_v v LEFT JOIN {name}_t t ON t.store = v.store AND t.article = v.article AND t.day = v.day AND t.stop = v.stop),
{name}_n AS (SELECT *, coalesce(n_all >= 3 AND since IS NOT NULL AND ever > 0 AND after_low >= 3 AND inside >= 3 AND poured > 0 AND last_q > 0 AND k BETWEEN 0.25 AND 5, FALSE) AS by_till, CASE WHEN fresh THEN to_day ELSE to_end + rate * greatest(0, day - greatest(stop_till, last_day)) END AS used FROM {name}_k),
{name}_c AS (SELECT *, CASE WHEN n_all < 3 THEN NULL WHEN by_till THEN k * (greatest(used, 0) + rate * gap) / last_q WHEN daily <> 0 AND last_q > 0 THEN (day - last_day + gap) / (last_q / daily) END AS need, CASE WHEN back > 0 AND qty > 0 AND back >= 0.5 * qty THEN 'deposit' WHEN n_all >= 3 AND last_here < third THEN 'elsewhere' ELSE 'ok' END AS status FROM {name}_n),
{name} AS (SELECT *, CASE WHEN n_all < 3 OR need IS NULL THEN NULL WHEN by_till THEN 'till' ELSE 'calendar' END AS clock, coalesce(ever > 0 AND lately > 0, FALSE) AS still, 1 / (1 + exp(-(ln(least(greatest(habit, 1e-4), 1 - 1e-4) / (1 - least(greatest(habit, 1e-4), 1 - 1e-4))) + 0.39 + 0.82 * ln(least(greatest(coalesce(need, 1), 0.1), 2)) - CASE WHEN n_all < 3 THEN 2.0 ELSE 0 END))) AS chance FROM {name}_c)
"""


PAST = _scores("past", "SELECT store, article, day, day AS stop FROM pairs JOIN recent USING (store)")


@query(f"""
WITH {TABLES}, {PAST} SELECT store, article, day, r, status, clock, round(habit, 6) AS habit, round(need, 6) AS need, round(chance, 6) AS chance, EXISTS (SELECT 1 FROM buys b WHERE b.store = past.store AND b.article = past.article AND b.day = past.day) AS bought FROM past JOIN recent USING (store, day)
""")
def visit_replay(spark, sf_dir):
    """What each store's list said of each article on the morning of its last five visits."""
    buys, visits, sold, returned = (df.filter("day <= date'2000-06-30'") for df in _tables(spark, sf_dir))
    out = replay.replayed(buys.select("store", "article").distinct(), buys, visits, sold, returned, SEASON)
    return out.select("store", "article", "day", F.col("r").cast("long").alias("r"), "status", "clock", *(F.round(c, 6).alias(c) for c in ("habit", "need", "chance")), "bought")


@query(f"""
WITH {TABLES}, {_scores("now", "SELECT store, article, DATE '2000-06-30' AS day, DATE '2000-07-01' AS stop FROM pairs")}, {PAST},
l AS (SELECT store, article, CASE WHEN 1 / (1 + exp(-(ln(habit / (1 - habit)) + 0.39))) < 0.25 THEN 3 ELSE 5 END AS k FROM now WHERE status = 'ok' AND chance >= 0.25),
i AS (SELECT store, article, l.k FROM l JOIN past USING (store, article) JOIN recent USING (store, day) WHERE r <= l.k AND past.status = 'ok' AND past.chance >= 0.25 AND NOT EXISTS (SELECT 1 FROM buys b WHERE b.store = past.store AND b.article = past.article AND b.day = past.day) GROUP BY 1, 2, 3 HAVING count(*) = l.k),
m AS (SELECT article, median(gap) AS median_gap FROM (SELECT article, day - lag(day) OVER (PARTITION BY article ORDER BY day) AS gap FROM per) AS q GROUP BY 1),
s AS (SELECT now.*, i.k AS insisted, CASE WHEN n_all >= 3 AND median_gap > 0 AND status <> 'deposit' AND day - last_day > greatest(3 * median_gap, 60) THEN CASE WHEN still THEN 'paused' ELSE 'dropped' END END AS silent FROM now LEFT JOIN i ON i.store = now.store AND i.article = now.article LEFT JOIN m ON m.article = now.article)
SELECT store, article, n_all, n_here, status, clock, silent, CAST(insisted AS INTEGER) AS insisted, round(habit, 6) AS habit, round(need, 6) AS need, round(chance, 6) AS chance,
  CASE WHEN status = 'deposit' THEN 'deposit' WHEN status = 'elsewhere' AND day - last_here <= 365 THEN 'elsewhere' WHEN status <> 'ok' THEN NULL WHEN insisted IS NOT NULL THEN 'maybe' WHEN chance >= 0.25 THEN 'buy' WHEN chance >= 0.125 THEN 'maybe' WHEN n_all < 3 AND day - first_day <= 90 THEN 'new' WHEN silent IS NOT NULL AND day - last_here <= 365 THEN 'quiet' END AS section FROM s
""")
def store_list(spark, sf_dir):
    """Every store's list today, by both clocks, and what it has stopped insisting on."""
    out = replay.plan(*_tables(spark, sf_dir), SEASON)
    return out.select("store", "article", F.col("n_all").cast("long").alias("n_all"), "n_here", "status", "clock", "silent", "insisted", *(F.round(c, 6).alias(c) for c in ("habit", "need", "chance")), "section")


def _runs(spark, sf_dir):
    """A log of searches: an order is a run; every fourth is by hand over a past stretch; a third of the time all of them fail."""
    i, day = F.col("line_id"), F.col("day")
    since = F.date_sub(day, (i % 200).cast("int"))
    rows = views.bank_lines(spark, sf_dir)
    own = F.date_add(F.lit(date(1995, 1, 1)), (i % 12 * 30).cast("int"))
    return rows.select(
        (i % 12).alias("source"), (F.unix_date("day").cast("long") * 10_000_000 + i).alias("run"), day.alias("today"), (i % 4 != 0).alias("automatic"), since.alias("since"), F.when(i % 4 != 0, day).otherwise(F.date_add(since, (i % 150).cast("int"))).alias("until"),
        ((i % 7 != 0) & (F.floor(F.unix_date("day") / 120) % 3 != 0)).alias("ok"), own.alias("own"), F.when(i % 12 % 3 == 0, F.date_add(own, 400)).alias("floor"),
    )


@query("""
WITH r AS (SELECT line_id % 12 AS source, (day - DATE '1970-01-01') * 10000000 + line_id AS run, day AS today, line_id % 4 <> 0 AS automatic, day - CAST(line_id % 200 AS INTEGER) AS since, CASE WHEN line_id % 4 <> 0 THEN day ELSE day - CAST(line_id % 200 AS INTEGER) + CAST(line_id % 150 AS INTEGER) END AS until,
  line_id % 7 <> 0 AND ((day - DATE '1970-01-01') // 120) % 3 <> 0 AS ok, DATE '1995-01-01' + CAST(line_id % 12 * 30 AS INTEGER) AS own, CASE WHEN line_id % 12 % 3 = 0 THEN DATE '1995-01-01' + CAST(line_id % 12 * 30 + 400 AS INTEGER) END AS floor FROM bank_lines),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run) AS n, least(until, today) AS stop FROM r),
w AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS run, CAST(NULL AS DATE) AS since, CAST(NULL AS DATE) AS known, CAST(NULL AS DATE) AS hole, CAST(NULL AS DATE) AS hole_end FROM o
UNION ALL SELECT source, n, run, since, CASE WHEN NOT ok THEN known WHEN cut THEN stop WHEN known IS NOT NULL AND since <= known + 1 THEN greatest(known, stop) WHEN known IS NULL AND since <= own AND own <= stop THEN stop WHEN known IS NULL THEN least(own + 3, today) ELSE known END,
  CASE WHEN ok AND covered AND stop >= coalesce(hole_end, today - 91) THEN NULL WHEN ok AND covered THEN stop + 1 ELSE hole END, CASE WHEN ok AND covered AND stop >= coalesce(hole_end, today - 91) THEN NULL ELSE hole_end END
  FROM (SELECT *, hole IS NOT NULL AND since <= greatest(hole, floor) AND greatest(hole, floor) <= stop AS covered FROM (SELECT o.source, o.n, o.run, o.ok, o.today, o.own, o.floor, o.stop, w.known, o.automatic AND coalesce(w.known - 3, o.own) < o.today - 90 AS cut,
    CASE WHEN NOT o.automatic THEN o.since ELSE greatest(coalesce(w.known - 3, o.own), o.today - 90) END AS since, CASE WHEN o.automatic AND coalesce(w.known - 3, o.own) < o.today - 90 THEN least(w.hole, coalesce(w.known - 3, o.own)) ELSE w.hole END AS hole,
    CASE WHEN o.automatic AND coalesce(w.known - 3, o.own) < o.today - 90 THEN CASE WHEN w.hole IS NOT NULL AND w.hole_end IS NOT NULL THEN greatest(w.hole_end, o.today - 91) ELSE o.today - 91 END ELSE w.hole_end END AS hole_end FROM w JOIN o ON o.source = w.source AND o.n = w.n + 1) AS q) AS q)
SELECT source, run, since, known AS searched_until, hole AS hole_from, hole_end AS hole_until FROM w WHERE n > 0
""")
def search_progress(spark, sf_dir):
    """Every search of a log: where it began, how far its source was known to be searched after it, and what is left to catch up."""
    return progress.steps(_runs(spark, sf_dir))
