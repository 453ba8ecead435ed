"""Queries over the bank and the till's payments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import bank
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query

D = "double"

#: Typed balances: at the first operation of each quarter, what the ledger says, some of them off by a hundred.
POINTS = """
daily AS (SELECT account, day, sum(amount) AS moved FROM bank_lines GROUP BY 1, 2),
ran AS (SELECT *, sum(moved) OVER (PARTITION BY account ORDER BY day) AS s FROM daily),
firsts AS (SELECT account, min(day) AS day FROM daily GROUP BY account, date_trunc('quarter', day)),
points AS (SELECT account, day, s + CASE WHEN month(day) = 4 THEN 100 ELSE 0 END AS balance FROM ran JOIN firsts USING (account, day)),
lined AS (SELECT account, day, moved, s, balance FROM ran LEFT JOIN points USING (account, day))
"""


def _points(lines):
    daily = bank.running(lines, "account", "day", "amount", "s")
    firsts = daily.groupBy("account", F.date_trunc("quarter", "day").alias("q")).agg(F.min("day").alias("day")).select("account", "day")
    off = F.when(F.month("day") == 4, F.lit(100)).otherwise(0)
    return daily.join(firsts, ["account", "day"]).select("account", "day", (F.col("s") + off).cast("decimal(24,2)").alias("balance"))


@query(f"""
WITH {POINTS},
r AS (SELECT *, last_value(balance IGNORE NULLS) OVER w AS b, last_value(CASE WHEN balance IS NOT NULL THEN s END IGNORE NULLS) OVER w AS bs FROM lined WINDOW w AS (PARTITION BY account ORDER BY day))
SELECT account, day, CAST(b + s - bs AS DOUBLE) AS balance, CAST(moved AS DOUBLE) AS moved FROM r
""")
def treasury_curve(spark, sf_dir):
    lines = views.bank_lines(spark, sf_dir)
    out = bank.balances(lines, _points(lines))
    return out.select("account", "day", F.col("balance").cast(D).alias("balance"), F.col("moved").cast(D).alias("moved"))


@query(f"""
WITH {POINTS}, t AS (SELECT * FROM lined WHERE balance IS NOT NULL),
g AS (SELECT account, day, balance, balance - lag(balance) OVER w - (s - lag(s) OVER w) AS missing FROM t WINDOW w AS (PARTITION BY account ORDER BY day))
SELECT account, day, CAST(balance AS DOUBLE) AS balance, CAST(missing AS DOUBLE) AS missing, coalesce(missing <> 0 AND missing + lead(missing) OVER (PARTITION BY account ORDER BY day) = 0, false) AS suspect FROM g
""")
def treasury_gaps(spark, sf_dir):
    lines = views.bank_lines(spark, sf_dir)
    out = bank.gaps(lines, _points(lines))
    return out.select("account", "day", F.col("balance").cast(D).alias("balance"), F.col("missing").cast(D).alias("missing"), "suspect")


@query("""
WITH per AS (SELECT account, CAST(date_trunc('month', day) AS DATE) AS month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS credits, sum(CASE WHEN amount < 0 THEN amount ELSE 0 END) AS debits, count(*) AS n FROM bank_lines GROUP BY 1, 2),
spine AS (SELECT account, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM per GROUP BY account),
m AS (SELECT account, month, coalesce(credits, 0) AS credits, coalesce(debits, 0) AS debits, coalesce(n, 0) AS n_lines FROM spine LEFT JOIN per USING (account, month))
SELECT account, month, CAST(credits AS DOUBLE) AS credits, CAST(debits AS DOUBLE) AS debits, n_lines, CAST(credits + debits AS DOUBLE) AS net, CAST(sum(credits + debits) OVER (PARTITION BY account ORDER BY month) AS DOUBLE) AS closing FROM m
""")
def treasury_months(spark, sf_dir):
    out = bank.months(views.bank_lines(spark, sf_dir))
    return out.select("account", "month", *(F.col(c).cast(D).alias(c) for c in ("credits", "debits")), "n_lines", *(F.col(c).cast(D).alias(c) for c in ("net", "closing")))


@query("""
WITH i AS (SELECT account, day, day + CAST(line_id % 4 AS INTEGER) AS imported_on FROM bank_lines), e AS (SELECT account, max(day) AS last, max(imported_on) AS newest FROM i GROUP BY 1), l AS (SELECT e.account, last, newest, max(imported_on) AS of_last FROM e JOIN i ON i.account = e.account AND i.day = e.last GROUP BY 1, 2, 3)
SELECT account, CAST(least(CASE WHEN of_last > last THEN last ELSE last - 1 END, newest - 1) AS DATE) AS complete_through, CAST(min(least(CASE WHEN of_last > last THEN last ELSE last - 1 END, newest - 1)) OVER () AS DATE) AS all_complete FROM l
""")
def treasury_complete(spark, sf_dir):
    """How far each account's lines are complete, and all together: as far as the first of them. A row an account."""
    lines = views.bank_lines(spark, sf_dir)
    return bank.complete_through(lines.withColumn("imported_on", F.date_add("day", (F.col("line_id") % 4).cast("int")))).withColumn("all_complete", F.min("complete_through").over(Window.partitionBy()))


#: Points as above, those of July read before the day's operations; an adjustment of 50 in every August; lines imported
#: up to March 1998.
REPORT = """
daily AS (SELECT account, day, sum(amount) AS moved FROM bank_lines GROUP BY 1, 2), ran AS (SELECT *, sum(moved) OVER (PARTITION BY account ORDER BY day) AS s FROM daily),
firsts AS (SELECT account, min(day) AS day FROM daily GROUP BY account, date_trunc('quarter', day)), points AS (SELECT account, day, s + CASE month(day) WHEN 4 THEN 100 WHEN 7 THEN -moved ELSE 0 END AS balance FROM ran JOIN firsts USING (account, day)),
adj0 AS (SELECT account, min(day) AS day FROM daily WHERE month(day) = 8 GROUP BY account, year(day)), pspan AS (SELECT account, min(day) AS p0, max(day) AS p1 FROM points GROUP BY 1), adj AS (SELECT account, day, 50 AS amount FROM adj0 JOIN pspan USING (account) WHERE day > p0 AND day <= p1),
i AS (SELECT account, day, day + CAST(line_id % 4 AS INTEGER) AS imported_on FROM bank_lines WHERE day < DATE '1998-03-01'), e AS (SELECT account, max(day) AS last, max(imported_on) AS newest FROM i GROUP BY 1), l AS (SELECT e.account, last, newest, max(imported_on) AS of_last FROM e JOIN i ON i.account = e.account AND i.day = e.last GROUP BY 1, 2, 3),
complete AS (SELECT account, CAST(least(CASE WHEN of_last > last THEN last ELSE last - 1 END, newest - 1) AS DATE) AS c FROM l),
led AS (SELECT account, day, moved, s, balance, coalesce(amount, 0) AS a, sum(coalesce(amount, 0)) OVER (PARTITION BY account ORDER BY day) AS t FROM ran LEFT JOIN points USING (account, day) LEFT JOIN adj USING (account, day)),
g0 AS (SELECT account, day, moved, balance - lag(balance) OVER w - (s - lag(s) OVER w) AS raw, balance - lag(balance) OVER w - (s - lag(s) OVER w) - (t - lag(t) OVER w) AS missing, lag(moved) OVER w AS earlier, day > c AS pending FROM led JOIN complete USING (account) WHERE balance IS NOT NULL WINDOW w AS (PARTITION BY account ORDER BY day)),
g1 AS (SELECT *, coalesce(missing <> 0 AND NOT pending, false) AS open FROM g0),
g AS (SELECT *, coalesce(raw <> 0 AND raw = -lead(raw) OVER w AND NOT pending AND NOT lead(pending) OVER w AND (open OR lead(open) OVER w), false) AS suspect, CASE WHEN open AND moved <> 0 AND missing = -moved THEN 'after' WHEN open AND earlier <> 0 AND missing = earlier THEN 'before' END AS read_before FROM g1 WINDOW w AS (PARTITION BY account ORDER BY day))
"""


def _report(spark, sf_dir):
    lines = views.bank_lines(spark, sf_dir)
    daily = lines.groupBy("account", "day").agg(F.sum("amount").alias("moved")).withColumn("s", F.sum("moved").over(Window.partitionBy("account").orderBy("day")))
    firsts = daily.groupBy("account", F.date_trunc("quarter", "day").alias("q")).agg(F.min("day").alias("day")).select("account", "day")
    off = F.when(F.month("day") == 4, 100).when(F.month("day") == 7, -F.col("moved")).otherwise(0)
    points = daily.join(firsts, ["account", "day"]).select("account", "day", (F.col("s") + off).cast("decimal(24,2)").alias("balance"))
    adjustments = daily.filter(F.month("day") == 8).groupBy("account", F.year("day")).agg(F.min("day").alias("day")).select("account", "day", F.lit(50).cast("decimal(12,2)").alias("amount"))
    complete = bank.complete_through(lines.filter("day < date'1998-03-01'").withColumn("imported_on", F.date_add("day", (F.col("line_id") % 4).cast("int"))))
    return lines, points, adjustments, complete


@query(f"WITH {REPORT} SELECT account, day, CAST(missing AS DOUBLE) AS missing, pending, open, suspect, read_before FROM g WHERE missing IS NOT NULL")
def treasury_gap_report(spark, sf_dir):
    """Gaps between typed balances, with what each may be."""
    return bank.gap_report(*_report(spark, sf_dir)).withColumn("missing", F.col("missing").cast(D))


@query(f"""
WITH {REPORT}, spine AS (SELECT account, a, b, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT account, min(day) AS a, max(day) AS b FROM led GROUP BY 1)),
m AS (SELECT account, month, CAST(greatest(month, a) AS DATE) AS start, CAST(least(last_day(month), b) AS DATE) AS fin FROM spine), f AS (SELECT account, min(day) AS d0, arg_min(balance, day) AS b0, arg_min(s, day) AS s0, arg_min(t, day) AS t0 FROM led WHERE balance IS NOT NULL GROUP BY 1),
x AS (SELECT m.*, c, d0, b0, s0, t0, (SELECT arg_max(s, day) FROM led WHERE led.account = m.account AND day <= fin) AS s, (SELECT arg_max(t, day) FROM led WHERE led.account = m.account AND day <= fin) AS t, (SELECT arg_max(balance, day) FROM led WHERE led.account = m.account AND day <= fin AND balance IS NOT NULL) AS b,
  (SELECT arg_max(s, day) FROM led WHERE led.account = m.account AND day <= fin AND balance IS NOT NULL) AS sb, (SELECT arg_max(t, day) FROM led WHERE led.account = m.account AND day <= fin AND balance IS NOT NULL) AS tb, (SELECT max(day) FROM led WHERE led.account = m.account AND day <= fin AND balance IS NOT NULL) AS db FROM m JOIN f USING (account) JOIN complete USING (account))
SELECT account, month, start, fin AS "end", CAST(coalesce((SELECT sum(amount) FROM bank_lines l WHERE l.account = x.account AND l.day BETWEEN start AND fin AND amount > 0), 0) AS DOUBLE) AS credits, CAST(coalesce((SELECT sum(amount) FROM bank_lines l WHERE l.account = x.account AND l.day BETWEEN start AND fin AND amount < 0), 0) AS DOUBLE) AS debits,
  CAST(coalesce((SELECT sum(a) FROM led WHERE led.account = x.account AND led.day BETWEEN start AND fin), 0) AS DOUBLE) AS adjustments, CAST(coalesce(b, b0) + s - coalesce(sb, s0) + t - coalesce(tb, t0) AS DOUBLE) AS closing, CASE WHEN db = fin THEN false WHEN db IS NOT NULL THEN fin > c ELSE d0 > c END AS provisional,
  CAST(coalesce((SELECT sum(missing) FROM g WHERE g.account = x.account AND g.day BETWEEN start AND fin AND open), 0) AS DOUBLE) AS gap, (SELECT count(*) FROM g WHERE g.account = x.account AND g.day BETWEEN start AND fin AND open) AS n_gaps FROM x
""")
def treasury_month_rows(spark, sf_dir):
    """Months of each account with closing balance and open gaps."""
    out = bank.month_rows(*_report(spark, sf_dir))
    return out.select("account", "month", "start", "end", *(F.col(c).cast(D).alias(c) for c in ("credits", "debits", "adjustments", "closing")), "provisional", F.col("gap").cast(D).alias("gap"), "n_gaps")


#: Payouts: every fourth day of a method pays the three card days before it, less 1 on every fifth.
PAYOUTS = """
sold AS (SELECT method AS key, day, amount FROM till_payments), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS i, sum(amount) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS three FROM sold),
payouts AS (SELECT key, day, three - CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS gross FROM n WHERE i % 4 = 0)
"""


def _payouts(spark, sf_dir):
    sold = views.till_payments(spark, sf_dir).select(F.col("method").alias("key"), "day", F.col("amount").cast("decimal(22,2)").alias("amount"))
    w = Window.partitionBy("key").orderBy("day")
    n = sold.withColumn("i", F.row_number().over(w)).withColumn("three", F.sum("amount").over(w.rowsBetween(-3, -1)))
    return sold, n.filter("i % 4 = 0").select("key", "day", (F.col("three") - F.when(F.col("i") % 5 == 0, 1).otherwise(0)).cast("decimal(22,2)").alias("gross"))


@query(f"""
WITH {PAYOUTS},
st AS (SELECT key, min(day) AS f FROM sold GROUP BY 1), paid AS (SELECT p.*, f FROM payouts p JOIN st USING (key) WHERE p.day > f), t AS (SELECT key, min(day) AS t1, arg_min(gross, day) AS g1, any_value(f) AS f FROM paid GROUP BY 1),
c AS (SELECT key, t1, g1, CAST(unnest(generate_series(greatest(f, t1 - 7), t1 - 1, INTERVAL 1 DAY)) AS DATE) AS anchor FROM t),
o AS (SELECT c.key, anchor, abs(coalesce((SELECT sum(amount) FROM sold s WHERE s.key = c.key AND s.day >= anchor AND s.day < t1), 0) - g1) AS off FROM c),
a AS (SELECT key, anchor FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY off, anchor DESC) AS r FROM o) WHERE r = 1)
SELECT p.key, p.day, CAST(p.gross AS DOUBLE) AS gross, CAST(coalesce((SELECT sum(amount) FROM sold s WHERE s.key = p.key AND s.day >= a.anchor AND s.day < p.day), 0) - sum(p.gross) OVER (PARTITION BY p.key ORDER BY p.day) AS DOUBLE) AS unpaid FROM paid p JOIN a USING (key)
""")
def payout_running_balance(spark, sf_dir):
    out = bank.unpaid_after_payouts(*_payouts(spark, sf_dir))
    return out.select("key", "day", F.col("gross").cast(D).alias("gross"), F.col("unpaid").cast(D).alias("unpaid"))


@query()
def payout_exact_runs(spark, sf_dir):
    return bank.exact_runs(*_payouts(spark, sf_dir))


@query("""
WITH b AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, 'bank' AS source, sum(amount) AS amount, count(DISTINCT day) AS n_days FROM bank_lines WHERE amount > 0 GROUP BY 1),
t AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, method AS source, sum(amount) AS amount, count(DISTINCT day) AS n_days FROM till_payments GROUP BY 1, 2), u AS (SELECT * FROM b UNION ALL SELECT * FROM t)
SELECT month, source, CAST(amount AS DOUBLE) AS amount, n_days, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY month) AS DOUBLE) AS share FROM u
""")
def income_by_month(spark, sf_dir):
    month = F.trunc("day", "MM").alias("month")
    b = views.bank_lines(spark, sf_dir).filter("amount > 0").groupBy(month).agg(F.sum("amount").alias("amount"), F.count_distinct("day").alias("n_days")).withColumn("source", F.lit("bank"))
    t = views.till_payments(spark, sf_dir).groupBy(month, F.col("method").alias("source")).agg(F.sum("amount").alias("amount"), F.count_distinct("day").alias("n_days"))
    u = b.select("month", "source", F.col("amount").cast("decimal(38,2)").alias("amount"), "n_days").unionByName(t.select("month", "source", F.col("amount").cast("decimal(38,2)").alias("amount"), "n_days"))
    share = F.col("amount").cast(D) / F.sum("amount").over(Window.partitionBy("month")).cast(D)
    return u.select("month", "source", F.col("amount").cast(D).alias("amount"), "n_days", share.alias("share"))


@query("""
WITH debits AS (SELECT line_id, payee_id, -amount AS due FROM bank_lines WHERE amount < 0),
parts AS (SELECT invoice_id, category, sum(ht) AS part FROM lines JOIN products USING (product_id) GROUP BY 1, 2), met AS (SELECT line_id, due, category, CAST(part * 100 AS HUGEINT) AS p, CAST(due * 100 AS HUGEINT) AS d, CAST(sum(part) OVER (PARTITION BY line_id) * 100 AS HUGEINT) AS t FROM debits JOIN parts ON line_id = invoice_id),
cut AS (SELECT line_id, category, d, t, CASE WHEN t > d THEN (2 * p * d + t) // (2 * t) ELSE p END AS c, row_number() OVER (PARTITION BY line_id ORDER BY p DESC, category) AS r FROM met),
scaled AS (SELECT line_id, category, CAST(c + CASE WHEN r = 1 AND t > d THEN d - sum(c) OVER (PARTITION BY line_id) ELSE 0 END AS DECIMAL(24,2)) / 100 AS amount FROM cut),
sums AS (SELECT line_id, CAST(sum(amount) AS DECIMAL(24,2)) AS given FROM scaled GROUP BY 1), rest AS (SELECT line_id, CASE WHEN given IS NULL THEN 'segment ' || c_mktsegment ELSE 'uncategorised' END AS category, due - coalesce(given, 0) AS amount FROM debits LEFT JOIN sums USING (line_id) JOIN customer ON c_custkey = payee_id),
u AS (SELECT category, CAST(amount AS DECIMAL(24,2)) AS amount FROM scaled UNION ALL SELECT category, amount FROM rest WHERE amount <> 0), s AS (SELECT category, sum(amount) AS amount, count(*) AS n_parts FROM u GROUP BY 1),
z AS (SELECT *, CASE WHEN amount > 0 THEN (2 * CAST(amount * 100 AS HUGEINT) * 1000 + w) // (2 * w) END AS tenths, row_number() OVER (ORDER BY amount DESC, category) AS r FROM (SELECT *, CAST(sum(amount) FILTER (WHERE amount > 0) OVER () * 100 AS HUGEINT) AS w FROM s) AS q)
SELECT category, CAST(amount AS DOUBLE) AS amount, n_parts, amount > 0 AS drawn, CAST(tenths + CASE WHEN r = 1 THEN 1000 - sum(tenths) OVER () ELSE 0 END AS DOUBLE) / 10 AS share FROM z
""")
def spending_by_category(spark, sf_dir):
    """Debits by the categories of their invoices, scaled down where these ask for more, what rounding leaves on the largest; the
    rest has the payee's segment, or no category where there are invoices. What nets to nothing is not drawn; shares add up."""
    debits = views.bank_lines(spark, sf_dir).filter("amount < 0").select("line_id", "payee_id", (-F.col("amount")).alias("due"))
    parts = views.lines(spark, sf_dir).join(views.products(spark, sf_dir), "product_id").groupBy(F.col("invoice_id").alias("line_id"), "category").agg(F.sum("ht").alias("part"))
    cents = lambda c: (c * 100).cast("decimal(17,0)")
    line = Window.partitionBy("line_id")
    met = debits.join(parts, "line_id").select("line_id", "category", cents(F.col("part")).alias("p"), cents(F.col("due")).alias("d"), cents(F.sum("part").over(line)).alias("t"))
    # Cents to the nearest, halves up, without a division that rounds first.
    cut = met.withColumn("c", F.when(F.col("t") > F.col("d"), F.expr("(2 * p * d + t) div (2 * t)").cast("decimal(17,0)")).otherwise(F.col("p"))).withColumn("r", F.row_number().over(line.orderBy(F.desc("p"), "category")))
    left = F.when((F.col("r") == 1) & (F.col("t") > F.col("d")), F.col("d") - F.sum("c").over(line)).otherwise(0)
    given = cut.select("line_id", "category", ((F.col("c") + left) / 100).cast("decimal(24,2)").alias("amount"))
    sums = given.groupBy("line_id").agg(F.sum("amount").alias("given"))
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("payee_id"), "c_mktsegment")
    rest = debits.join(sums, "line_id", "left").join(segment, "payee_id").select(F.when(F.col("given").isNull(), F.concat(F.lit("segment "), "c_mktsegment")).otherwise(F.lit("uncategorised")).alias("category"), (F.col("due") - F.coalesce("given", F.lit(0))).cast("decimal(24,2)").alias("amount"))
    u = given.select("category", "amount").unionByName(rest.filter("amount != 0"))
    # A row a category from here on.
    all_, drawn = Window.partitionBy(), F.col("amount") > 0
    rows = u.groupBy("category").agg(F.sum("amount").alias("amount"), F.count("*").alias("n_parts")).withColumn("a", cents(F.col("amount"))).withColumn("w", F.sum(F.when(drawn, F.col("a"))).over(all_).cast("decimal(17,0)"))
    rows = rows.withColumn("tenths", F.when(drawn, F.expr("(2 * a * 1000 + w) div (2 * w)"))).withColumn("r", F.row_number().over(all_.orderBy(F.desc("amount"), "category")))
    share = (F.col("tenths") + F.when(F.col("r") == 1, 1000 - F.sum("tenths").over(all_)).otherwise(0)).cast(D) / 10
    return rows.select("category", F.col("amount").cast(D).alias("amount"), "n_parts", drawn.alias("drawn"), share.alias("share"))


@query("""
WITH c AS (SELECT payee_id AS key, line_id AS id, amount, sum(amount) OVER w AS hi FROM bank_lines WHERE amount > 0 WINDOW w AS (PARTITION BY payee_id ORDER BY day, line_id)),
d AS (SELECT payee_id AS key, line_id AS id, -amount AS due, sum(-amount) OVER w AS hi FROM bank_lines WHERE amount < 0 WINDOW w AS (PARTITION BY payee_id ORDER BY day, line_id))
SELECT c.key, c.id AS credit_id, d.id AS doc_id, CAST(least(c.hi, d.hi) - greatest(c.hi - amount, d.hi - due) AS DOUBLE) AS share FROM c JOIN d USING (key) WHERE c.hi - amount < d.hi AND d.hi - due < c.hi
""")
def credit_waterfall(spark, sf_dir):
    """Credits of each payee over what it was asked for, in order."""
    rows = views.bank_lines(spark, sf_dir).withColumnsRenamed({"payee_id": "key", "line_id": "id"})
    out = bank.waterfall(rows.filter("amount > 0"), rows.filter("amount < 0").withColumn("due", -F.col("amount")))
    return out.withColumn("share", F.col("share").cast(D))


@query("""
WITH t AS (SELECT payee_id, day, sum(sum(amount)) OVER (PARTITION BY payee_id ORDER BY day) AS balance FROM bank_lines GROUP BY payee_id, day)
SELECT e.event_id, t.day AS known_on, CAST(t.balance AS DOUBLE) AS balance FROM (SELECT event_id, user_id, CAST(CAST(ts AS DATE) - 9000 AS DATE) AS d FROM events) e ASOF LEFT JOIN t ON e.user_id = t.payee_id AND e.d >= t.day
""")
def asof_balance(spark, sf_dir):
    """The last known balance of each event's user: both sides in one sorted pass, no range join."""
    known = bank.running(views.bank_lines(spark, sf_dir), "payee_id", "day", "amount", "balance").select(F.col("payee_id").alias("user_id"), F.col("day").alias("d"), F.lit(0).alias("side"), F.struct("day", "balance").alias("known"), F.lit(None).cast("long").alias("event_id"))
    asked = table(spark, sf_dir, "events").select("user_id", F.date_sub(F.to_date("ts"), 9000).alias("d"), F.lit(1).alias("side"), F.lit(None).cast(known.schema["known"].dataType).alias("known"), "event_id")
    w = Window.partitionBy("user_id").orderBy("d", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = known.unionByName(asked).withColumn("ref", F.last("known", ignorenulls=True).over(w)).filter("side = 1")
    return out.select("event_id", F.col("ref.day").alias("known_on"), F.col("ref.balance").cast(D).alias("balance"))
