"""Queries that match payments with invoices, and merge intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph, matching
from ledgerloom.sources import views

from .registry import query

D = "double"

#: Payments: the debits of the bank, in hundreds; invoices: the credits' other side of the same customers, in hundreds too,
#: so that amounts meet.
BOTH = """
payments AS (SELECT line_id AS payment_id, payee_id AS key, day, CAST(ceil(-amount / 25000) * 25 AS DECIMAL(12,2)) AS due FROM bank_lines WHERE amount < 0),
invoices AS (SELECT line_id AS invoice_id, payee_id AS key, day AS invoice_day, CAST(ceil(amount / 25000) * 25 AS DECIMAL(12,2)) AS total FROM bank_lines WHERE amount > 0),
cand AS (SELECT p.payment_id, p.key, p.day, p.due, i.invoice_id, i.invoice_day, i.total FROM payments p JOIN invoices i ON p.key = i.key AND i.invoice_day >= p.day - 180 AND i.invoice_day <= p.day)
"""


def _payments(spark, sf_dir):
    rows = views.bank_lines(spark, sf_dir).filter("amount < 0")
    return rows.select(F.col("line_id").alias("payment_id"), F.col("payee_id").alias("key"), "day", (F.ceil(-F.col("amount") / 25000) * 25).cast("decimal(12,2)").alias("due"))


def _invoices(spark, sf_dir):
    rows = views.bank_lines(spark, sf_dir).filter("amount > 0")
    return rows.select(F.col("line_id").alias("invoice_id"), F.col("payee_id").alias("key"), F.col("day").alias("invoice_day"), (F.ceil(F.col("amount") / 25000) * 25).cast("decimal(12,2)").alias("total"))


@query(f"WITH {BOTH} SELECT payment_id, invoice_id, CAST(due AS DOUBLE) AS due, CAST(total AS DOUBLE) AS total, CAST(day - invoice_day AS INTEGER) AS age, total = due AS exact, abs(total - due) <= due * 0.10 AS near FROM cand")
def payment_candidates(spark, sf_dir):
    near = matching.in_window(_payments(spark, sf_dir), _invoices(spark, sf_dir))
    due, total = F.col("due"), F.col("total")
    return near.select("payment_id", "invoice_id", due.cast(D).alias("due"), total.cast(D).alias("total"), F.datediff("day", "invoice_day").alias("age"), (total == due).alias("exact"), (F.abs(total - due) <= due * F.lit("0.10").cast("decimal(3,2)")).alias("near"))


@query(f"""
WITH {BOTH}, x AS (SELECT payment_id, invoice_id, CAST(day - invoice_day AS INTEGER) AS age FROM cand WHERE total = due),
r AS (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n, lead(age) OVER w AS next, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY payment_id ORDER BY age, invoice_id))
SELECT payment_id, invoice_id, age, n AS n_candidates, CASE WHEN n = 1 THEN 'sure' WHEN age <= 35 AND next - age >= 20 THEN 'near_sure' ELSE 'to_confirm' END AS tier FROM r WHERE r = 1
""")
def payment_tiers(spark, sf_dir):
    return matching.tiers(matching.exact(_payments(spark, sf_dir), _invoices(spark, sf_dir)))


@query(f"""
WITH {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY invoice_day DESC, invoice_id DESC) AS r FROM cand), c AS (SELECT * FROM r WHERE r <= 12),
two AS (SELECT a.payment_id, a.due, a.r AS ra, b.r AS rb, a.total + b.total AS s FROM c a JOIN c b ON a.payment_id = b.payment_id AND a.r < b.r),
three AS (SELECT t.payment_id, t.due, d.r AS rb, t.s + d.total AS s FROM two t JOIN c d ON t.payment_id = d.payment_id AND t.rb < d.r), four AS (SELECT t.payment_id, t.due, t.s + d.total AS s FROM three t JOIN c d ON t.payment_id = d.payment_id AND t.rb < d.r),
u AS (SELECT payment_id, 2 AS n FROM two WHERE s = due UNION ALL SELECT payment_id, 3 FROM three WHERE s = due UNION ALL SELECT payment_id, 4 FROM four WHERE s = due)
SELECT payment_id, count(*) AS n_sums, CAST(min(n) AS BIGINT) AS smallest FROM u GROUP BY 1
""")
def payment_subset_sums(spark, sf_dir):
    return matching.subset_sums(_payments(spark, sf_dir), _invoices(spark, sf_dir))


@query()
def reconcile_greedy(spark, sf_dir):
    """Payments linked one after another, each to an exact total that it is sure of."""
    p, i = _read(spark, sf_dir)
    return matching.greedy(p, i)


#: The same with cards (every third), undated invoices (every nineteenth) and totals read four cents off (every fifth).
READ = """
pay AS (SELECT line_id AS payment_id, payee_id AS key, day, CAST(ceil(-amount / 25000) * 25 AS DECIMAL(12,2)) AS due, line_id % 3 = 0 AS card FROM bank_lines WHERE amount < 0),
inv AS (SELECT line_id AS invoice_id, payee_id AS key, CASE WHEN line_id % 19 <> 0 THEN day END AS invoice_day, CAST(ceil(amount / 25000) * 25 + CASE WHEN line_id % 5 = 0 THEN 0.04 ELSE 0 END AS DECIMAL(12,2)) AS total, line_id % 2 = 0 AS fresh FROM bank_lines WHERE amount > 0)
"""


def _read(spark, sf_dir):
    i = F.col("invoice_id")
    invoices = _invoices(spark, sf_dir).withColumn("invoice_day", F.when(i % 19 != 0, F.col("invoice_day"))).withColumn("total", (F.col("total") + F.when(i % 5 == 0, F.lit("0.04")).otherwise("0").cast("decimal(4,2)")).cast("decimal(12,2)")).withColumn("fresh", i % 2 == 0)
    return _payments(spark, sf_dir).withColumn("card", F.col("payment_id") % 3 == 0), invoices


#: Sets of two to four of twelve invoices (c: payment_id, due, r, invoice_id, total) that add up to the payment.
SETS = """
two AS (SELECT a.payment_id, a.due, b.r AS last, a.total + b.total AS s, [a.invoice_id, b.invoice_id] AS ids FROM c a JOIN c b ON a.payment_id = b.payment_id AND a.r < b.r),
three AS (SELECT t.payment_id, t.due, d.r AS last, t.s + d.total AS s, list_append(t.ids, d.invoice_id) AS ids FROM two t JOIN c d ON t.payment_id = d.payment_id AND t.last < d.r),
four AS (SELECT t.payment_id, t.due, d.r AS last, t.s + d.total AS s, list_append(t.ids, d.invoice_id) AS ids FROM three t JOIN c d ON t.payment_id = d.payment_id AND t.last < d.r),
sets AS (SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four),
r2 AS (SELECT payment_id, CASE WHEN count(*) = 1 THEN 'sum' ELSE 'sums' END AS rule, CASE WHEN count(*) = 1 THEN 'sure' ELSE 'to_confirm' END AS tier, least(count(*), 5) AS n_options, CASE WHEN count(*) = 1 THEN array_to_string(list_sort(any_value(ids)), '+') ELSE '' END AS first FROM sets WHERE s = due GROUP BY 1)
"""


@query(f"""
WITH {READ}, near AS (SELECT p.*, invoice_id, total, invoice_day, CAST(abs(day - invoice_day) AS BIGINT) AS age FROM pay p JOIN inv i ON p.key = i.key AND invoice_day BETWEEN day - CASE WHEN card THEN 3 ELSE 180 END AND day + CASE WHEN card THEN 1 ELSE 0 END),
x AS (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n, row_number() OVER w AS r, lead(age) OVER w AS nxt FROM near WHERE total = due WINDOW w AS (PARTITION BY payment_id ORDER BY age, invoice_id)),
r1 AS (SELECT payment_id, CASE WHEN n = 1 THEN 'exact' WHEN card AND age < nxt THEN 'nearest' ELSE 'several' END AS rule, CASE WHEN n = 1 OR (card AND age < nxt) THEN 'sure' WHEN age <= 35 AND nxt - age >= 20 THEN 'near_sure' ELSE 'to_confirm' END AS tier,
  CASE WHEN n = 1 OR (card AND age < nxt) THEN 1 ELSE least(n, 5) END AS n_options, CAST(invoice_id AS VARCHAR) AS first FROM x WHERE r = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY invoice_day DESC, invoice_id DESC) AS r FROM near WHERE payment_id NOT IN (SELECT payment_id FROM r1)) WHERE r <= 12), {SETS},
d1 AS (SELECT payment_id FROM r1 UNION ALL SELECT payment_id FROM r2), y AS (SELECT *, abs(total - due) AS gap FROM near WHERE payment_id NOT IN (SELECT payment_id FROM d1) AND abs(total - due) <= due * 0.10),
z AS (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n, count(*) FILTER (WHERE gap <= 0.05) OVER (PARTITION BY payment_id) AS within, row_number() OVER (PARTITION BY payment_id ORDER BY gap, age, invoice_id) AS r FROM y),
r3 AS (SELECT payment_id, 'close' AS rule, CASE WHEN within = 1 AND (card OR age <= 35) THEN 'near_sure' ELSE 'to_confirm' END AS tier, least(n, 5) AS n_options, CAST(invoice_id AS VARCHAR) AS first FROM z WHERE r = 1), d2 AS (SELECT payment_id FROM d1 UNION ALL SELECT payment_id FROM r3),
r4 AS (SELECT payment_id, 'undated' AS rule, 'to_confirm' AS tier, least(count(*), 5) AS n_options, CAST(arg_min(invoice_id, struct_pack(g := abs(total - due), i := invoice_id)) AS VARCHAR) AS first FROM pay JOIN inv USING (key) WHERE card AND invoice_day IS NULL AND abs(total - due) <= 0.01 AND payment_id NOT IN (SELECT payment_id FROM d2) GROUP BY 1),
r5 AS (SELECT payment_id, 'unnamed' AS rule, 'to_confirm' AS tier, least(count(*), 5) AS n_options, CAST(arg_min(invoice_id, struct_pack(g := abs(day - invoice_day), i := invoice_id)) AS VARCHAR) AS first FROM pay JOIN inv ON total = due AND invoice_day BETWEEN day - 3 AND day + 1 WHERE card AND payment_id NOT IN (SELECT payment_id FROM d2) AND payment_id NOT IN (SELECT payment_id FROM r4) GROUP BY 1)
SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5
""")
def payment_cascade(spark, sf_dir):
    """What each payment paid, and how sure that is."""
    return matching.cascade(*_read(spark, sf_dir))


@query(f"""
WITH {READ}, near AS (SELECT p.*, invoice_id, total, invoice_day, fresh, CAST(abs(day - invoice_day) AS BIGINT) AS age FROM pay p JOIN inv i ON p.key = i.key AND invoice_day BETWEEN day - 180 AND day + 90),
x AS (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n, row_number() OVER (PARTITION BY payment_id ORDER BY age, invoice_id) AS r FROM near WHERE total = due),
r1 AS (SELECT payment_id, CASE WHEN n > 1 THEN 'several' WHEN fresh THEN 'exact' ELSE 'balance' END AS rule, CASE WHEN n > 1 THEN 'to_confirm' WHEN fresh AND payment_id % 11 <> 0 THEN 'sure' ELSE 'near_sure' END AS tier, least(n, 5) AS n_options, CAST(invoice_id AS VARCHAR) AS first FROM x WHERE r = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY invoice_day DESC, invoice_id DESC) AS r FROM near WHERE fresh AND payment_id NOT IN (SELECT payment_id FROM r1)) WHERE r <= 12), {SETS},
d1 AS (SELECT payment_id FROM r1 UNION ALL SELECT payment_id FROM r2), y AS (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n, row_number() OVER (PARTITION BY payment_id ORDER BY abs(total - due), age, invoice_id) AS r FROM near WHERE payment_id NOT IN (SELECT payment_id FROM d1) AND abs(total - due) <= 0.05),
r3 AS (SELECT payment_id, 'close' AS rule, CASE WHEN n = 1 THEN 'near_sure' ELSE 'to_confirm' END AS tier, least(n, 5) AS n_options, CAST(invoice_id AS VARCHAR) AS first FROM y WHERE r = 1), d2 AS (SELECT payment_id FROM d1 UNION ALL SELECT payment_id FROM r3),
m AS (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n, row_number() OVER (PARTITION BY payment_id ORDER BY age, invoice_id) AS r FROM near WHERE total > due AND payment_id NOT IN (SELECT payment_id FROM d2)),
r4 AS (SELECT payment_id, 'deposit' AS rule, 'to_confirm' AS tier, least(n, 5) AS n_options, CAST(invoice_id AS VARCHAR) AS first FROM m WHERE r = 1), d3 AS (SELECT payment_id FROM d2 UNION ALL SELECT payment_id FROM r4),
r5 AS (SELECT payment_id, 'unnamed' AS rule, 'to_confirm' AS tier, least(count(*), 5) AS n_options, CAST(arg_min(invoice_id, struct_pack(g := abs(day - invoice_day), i := invoice_id)) AS VARCHAR) AS first FROM pay JOIN inv ON total = due AND invoice_day BETWEEN day - 180 AND day + 90 WHERE payment_id % 6 <> 0 AND payment_id NOT IN (SELECT payment_id FROM d3) GROUP BY 1)
SELECT * FROM r1 UNION ALL SELECT * REPLACE (CASE WHEN tier = 'sure' AND payment_id % 11 = 0 THEN 'near_sure' ELSE tier END AS tier) FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5
""")
def credit_cascade(spark, sf_dir):
    """The credit side: which document each amount received settles."""
    credits, documents = _read(spark, sf_dir)
    i = F.col("payment_id")
    return matching.credit_cascade(credits.withColumns({"by_label": i % 11 == 0, "recognised": i % 6 == 0}), documents)


@query("""
WITH w AS (SELECT payee_id, day - 7 AS a, day + 45 AS b FROM bank_lines WHERE amount > 0), o AS (SELECT *, max(b) OVER (PARTITION BY payee_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY payee_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT payee_id, min(a) AS first_day, max(b) AS last_day, count(*) AS n FROM i GROUP BY payee_id, i
""")
def interval_merge(spark, sf_dir):
    rows = views.bank_lines(spark, sf_dir).filter("amount > 0").select("payee_id", F.date_sub("day", 7).alias("first_day"), F.date_add("day", 45).alias("last_day"))
    return matching.merged_intervals(rows, "payee_id", "first_day", "last_day")


@query()
def slip_components(spark, sf_dir):
    """Slips and the references printed on them: what hangs together is compared together."""
    rows = views.lines(spark, sf_dir).filter("flag = 'R'").select((F.col("invoice_id") * 2).alias("a"), ((F.col("product_id") * 7 + F.col("supplier_id")) * 2 + 1).alias("b")).distinct()
    found = graph.components(rows)
    nodes = rows.select(F.col("a").alias("node")).unionByName(rows.select(F.col("b").alias("node"))).distinct()
    rooted = nodes.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.groupBy("root").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node") % 2 == 0).alias("n_slips"))


@query("""
SELECT b.line_id AS final_id, a.line_id AS deposit_id, CAST(b.amount AS DOUBLE) AS final_amount, CAST(a.amount AS DOUBLE) AS deposit_amount FROM bank_lines a JOIN bank_lines b ON a.payee_id = b.payee_id AND a.day < b.day AND abs(a.amount - b.amount) <= 500 WHERE a.amount > 0 AND b.amount > 0
""")
def deposits_counted_twice(spark, sf_dir):
    """An earlier credit of the same payee of nearly the same amount: a band join cut in equal bands."""
    rows = views.bank_lines(spark, sf_dir).filter("amount > 0")
    a = rows.select("payee_id", F.col("line_id").alias("deposit_id"), F.col("day").alias("d"), F.col("amount").alias("deposit_amount"), F.explode(F.array(*(F.floor(F.col("amount") / 500) + i for i in (-1, 0, 1)))).alias("band"))
    b = rows.select("payee_id", F.col("line_id").alias("final_id"), "day", F.col("amount").alias("final_amount"), F.floor(F.col("amount") / 500).alias("band"))
    met = a.join(b, ["payee_id", "band"]).filter((F.col("d") < F.col("day")) & (F.abs(F.col("deposit_amount") - F.col("final_amount")) <= 500))
    return met.select("final_id", "deposit_id", F.col("final_amount").cast(D).alias("final_amount"), F.col("deposit_amount").cast(D).alias("deposit_amount"))
