"""Queries over text, calendars, upserts, streams and plain analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as tx
from ledgerloom.functions import windows as wd
from ledgerloom.sources import views
from ledgerloom.sources.tables import table
from ledgerloom.streaming import till as stream

from .registry import query

D = "double"
FOLD = "strip_accents(lower({0}))"


@query("""
SELECT o_orderkey AS order_id, o_orderpriority AS name, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE (lower(o_orderpriority) LIKE '%urgent%' OR o_orderkey::VARCHAR LIKE '%urgent%') AND (year(o_orderdate) = 1997 OR lower(o_orderpriority) LIKE '%1997%' OR o_orderkey::VARCHAR LIKE '%1997%')
""")
def document_search(spark, sf_dir):
    """Every word of "urgent 1997" must be found, in the name, the number or the date."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("day"))
    found = F.lit(True)
    for word in ("urgent", "1997"):
        one = F.lower("name").contains(word) | F.col("order_id").cast("string").contains(word)
        found = found & ((one | (F.year("day") == int(word))) if word.isdigit() else one)
    return rows.filter(found)


@query(f"SELECT doc_id, (length({FOLD.format('text')}) - length(replace({FOLD.format('text')}, 'ete', ''))) // 3 AS n_hits FROM documents WHERE contains({FOLD.format('text')}, 'ete')")
def accent_search(spark, sf_dir):
    """Documents with "ete", accents and case aside."""
    key = tx.search_key(F.col("text"))
    return table(spark, sf_dir, "documents").filter(key.contains("ete")).select("doc_id", F.floor((F.length(key) - F.length(F.replace(key, F.lit("ete"), F.lit("")))) / 3).alias("n_hits"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""
WITH k AS (SELECT event_id, user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || event_type AS key FROM events), n AS (SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS occurrence FROM k)
SELECT event_id, occurrence, sha256(key || '|' || occurrence) AS fingerprint FROM n
""")
def fingerprint_occurrence(spark, sf_dir):
    """A line's fingerprint: its fields and its rank among identical lines."""
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string"), "event_type")
    rows = table(spark, sf_dir, "events").select("event_id", key.alias("key"))
    rows = rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy("key").orderBy("event_id")) - 1).cast("long"))
    return rows.select("event_id", "occurrence", F.sha2(F.concat_ws("|", "key", F.col("occurrence").cast("string")), 256).alias("fingerprint"))


#: What a guess must score, and how far ahead of the next.
ACCEPT, LEAD = 0.9, 1.5


@query("""
WITH w AS (SELECT p_partkey AS product_id, p_type AS category, unnest(regexp_extract_all(upper(p_name), '[A-Z]{3,}')) AS word FROM part), c AS (SELECT category, word, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT word, sum(n) AS all_n FROM c GROUP BY 1),
s AS (SELECT product_id, c.category, sum(CAST(c.n AS DOUBLE) / CAST(all_n AS DOUBLE)) AS score FROM (SELECT DISTINCT product_id, word FROM w) d JOIN c USING (word) JOIN t USING (word) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS second FROM s WINDOW o AS (PARTITION BY product_id ORDER BY round(score, 9) DESC, category))
SELECT product_id, category, round(score, 6) AS score, score >= 0.9 AND score >= 1.5 * coalesce(second, 0) AS accepted FROM r WHERE r = 1
""")
def word_classifier(spark, sf_dir):
    """A category by its words: each counts by how much of it the category has. Words say nothing of a product's category here,
    so few are accepted; ``word_classifier_own`` has words that do."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), F.explode(tx.name_words(F.col("p_name"))).alias("word"))
    return _guessed(rows)


def _guessed(rows):
    """Of ``rows`` (product_id, category, word) the best category of each product by its words, and whether it is good enough."""
    c = rows.groupBy("category", "word").agg(F.count("*").alias("n"))
    share = c.withColumn("share", F.col("n").cast(D) / F.sum("n").over(Window.partitionBy("word")).cast(D)).select("word", F.col("category").alias("guess"), "share")
    score = rows.select("product_id", "word").distinct().join(share, "word").groupBy("product_id", F.col("guess").alias("category")).agg(F.sum("share").alias("score"))
    o = Window.partitionBy("product_id").orderBy(F.round("score", 9).desc(), "category")
    best = score.withColumn("r", F.row_number().over(o)).withColumn("second", F.lead("score").over(o)).filter("r = 1")
    return best.select("product_id", "category", F.round("score", 6).alias("score"), ((F.col("score") >= ACCEPT) & (F.col("score") >= LEAD * F.coalesce("second", F.lit(0.0)))).alias("accepted"))


@query("""
WITH w AS (SELECT p_partkey AS product_id, p_brand AS category, unnest(list_filter(regexp_extract_all(upper(p_name || ' ' || p_brand || ' ' || CASE WHEN p_partkey % 3 = 0 THEN translate(substr(p_brand, 7), '0123456789', 'ABCDEFGHIJ') || 'XYZ' ELSE '' END), '[A-Z]{3,}'), lambda x: NOT list_contains(['BRAND', 'RED'], x))) AS word FROM part),
c AS (SELECT category, word, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT word, sum(n) AS all_n FROM c GROUP BY 1), s AS (SELECT product_id, c.category, sum(CAST(c.n AS DOUBLE) / CAST(all_n AS DOUBLE)) AS score FROM (SELECT DISTINCT product_id, word FROM w) d JOIN c USING (word) JOIN t USING (word) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS second FROM s WINDOW o AS (PARTITION BY product_id ORDER BY round(score, 9) DESC, category)) SELECT product_id, category, round(score, 6) AS score, score >= 0.9 AND score >= 1.5 * coalesce(second, 0) AS accepted FROM r WHERE r = 1
""")
def word_classifier_own(spark, sf_dir):
    """The same where every third name has a word that only its brand has; stop words say nothing."""
    own = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.translate(F.substring("p_brand", 7, 10), "0123456789", "ABCDEFGHIJ"), F.lit("XYZ"))).otherwise("")
    words = F.filter(tx.name_words(F.concat_ws(" ", "p_name", "p_brand", own)), lambda x: ~x.isin("BRAND", "RED"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("category"), F.explode(words).alias("word"))
    return _guessed(rows)


@query("""
WITH n AS (SELECT p_partkey AS product_id, p_name || ' ' || p_size || 'CL' || CASE WHEN p_size % 3 = 0 THEN ' x06' ELSE '' END AS name FROM part),
s AS (SELECT product_id, name, array_to_string(list_sort(list_transform(regexp_extract_all(name, '[0-9]+(?:[.,][0-9]+)?'), lambda x: regexp_replace(replace(x, ',', '.'), '^0+([0-9])', '\\1'))), ' ') AS signature FROM n)
SELECT signature, count(*) AS n_products, min(product_id) AS first_id FROM s GROUP BY 1
""")
def name_match_numbers(spark, sf_dir):
    """Products whose names have the same numbers."""
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("CL"), F.when(F.col("p_size") % 3 == 0, " x06").otherwise(""))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.array_join(tx.numeric_signature(name), " ").alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n_products"), F.min("product_id").alias("first_id"))


@query("""
SELECT p_partkey AS product_id, CAST(p_size * 0.01 AS DOUBLE) AS quantity, 'l' AS unit, CAST(CASE WHEN p_partkey % 4 = 0 THEN 6 ELSE 1 END AS INTEGER) AS times FROM part
""")
def size_extract(spark, sf_dir):
    """Pack sizes read back from names like "RED BOLT 6X33CL"."""
    name = F.concat(F.upper("p_name"), F.lit(" "), F.when(F.col("p_partkey") % 4 == 0, "6X").otherwise(""), F.col("p_size").cast("string"), F.lit("CL"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), tx.size_of(name).alias("s"))
    return rows.select("product_id", F.col("s.quantity").cast(D).alias("quantity"), "s.unit", "s.times")


@query("""
WITH b AS (SELECT s_suppkey AS supplier_id, lpad(CAST(s_suppkey * 7919 + 10000019 AS VARCHAR), 8, '4') AS b FROM supplier), w AS (SELECT supplier_id, b, (10 - list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 1 THEN CAST(b[i] AS INTEGER) ELSE (2 * CAST(b[i] AS INTEGER)) // 10 + (2 * CAST(b[i] AS INTEGER)) % 10 END)) % 10) % 10 AS digit FROM b)
SELECT supplier_id, b || digit AS siren, lpad(CAST((12 + 3 * (CAST(b || digit AS BIGINT) % 97)) % 97 AS VARCHAR), 2, '0') AS vat_key FROM w WHERE supplier_id % 3 <> 0
""")
def identifiers_luhn(spark, sf_dir):
    """Nine-digit identifiers printed in suppliers' letterheads that pass the Luhn check, with their VAT keys; every third has a
    wrong last digit, and other runs of digits stand around them."""
    base = F.lpad((F.col("s_suppkey") * 7919 + 10000019).cast("string"), 8, "4")
    doubled = lambda x: F.floor(2 * x / 10) + 2 * x % 10
    digits = F.transform(F.split(base, "(?!$)"), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(doubled(x.cast("int"))))
    digit = (10 - F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + x) % 10) % 10
    printed = (digit + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)) % 10
    text = F.concat(F.lit("Tel 0123456789 SIREN "), base, printed.cast("string"), F.lit(" / 12345678 - RCS"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.explode(tx.luhn_candidates(text)).alias("siren"))
    return rows.select("supplier_id", "siren", tx.vat_key(F.col("siren")).alias("vat_key"))


HOURS = "hours AS (SELECT user_id AS employee, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS v FROM events GROUP BY 1, 2)"


@query(f"""
WITH {HOURS} SELECT employee, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(CASE WHEN n % 5 <> 0 THEN n ELSE 0 END) AS BIGINT) AS worked, CAST(sum(n) AS BIGINT) AS planned, count(*) FILTER (WHERE n % 5 = 0) AS absences, count(*) FILTER (WHERE isodow(day) >= 6) AS weekend_days FROM hours GROUP BY 1, 2
""")
def timesheet_month(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("employee"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rows.groupBy("employee", F.trunc("day", "MM").alias("month")).agg(F.sum(F.when(F.col("n") % 5 != 0, F.col("n")).otherwise(0)).alias("worked"), F.sum("n").alias("planned"), F.count_if(F.col("n") % 5 == 0).alias("absences"), F.count_if(F.weekday("day") >= 5).alias("weekend_days"))


@query("""
SELECT user_id AS employee, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, month(date_trunc('week', min(ts))) <> month(date_trunc('week', min(ts)) + INTERVAL 6 DAY) AS partial FROM events GROUP BY 1, 2
""")
def iso_week_totals(spark, sf_dir):
    """Weeks from Monday; one that spans two months is partial in both."""
    week = F.to_date(F.date_trunc("week", "ts")).alias("week")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("employee"), week).agg(F.count("*").alias("n")).select("employee", "week", "n", (F.month("week") != F.month(F.date_add("week", 6))).alias("partial"))


EASTER = """
y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), b AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM a),
m AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM b), s AS (SELECT y, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS s FROM m), e AS (SELECT y, make_date(y, s // 31, s % 31 + 1) AS easter FROM s),
holidays AS (SELECT unnest([make_date(y, 1, 1), make_date(y, 5, 1), make_date(y, 5, 8), make_date(y, 7, 14), make_date(y, 8, 15), make_date(y, 11, 1), make_date(y, 11, 11), make_date(y, 12, 25), easter + 1, easter + 39, easter + 50]) AS day FROM e)
"""


@query(f"WITH {EASTER}, n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(h.day AS DATE) AS day, CAST(isodow(h.day) - 1 AS INTEGER) AS weekday, coalesce(n, 0) AS n_orders FROM (SELECT DISTINCT day FROM holidays) h LEFT JOIN n ON n.day = h.day")
def holiday_calendar(spark, sf_dir):
    """Public holidays of every year that has orders, and what was ordered on them."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    days = orders.select(F.year("day").alias("y")).distinct().select(F.explode(wd.holidays(F.col("y"))).alias("day")).distinct()
    n = orders.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.weekday("day").alias("weekday"), F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


DAYS = "SELECT CAST(ts - INTERVAL 6 HOUR AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


@query(DAYS)
def business_day_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(wd.business_day(F.col("ts")).alias("day"), "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").cast(D).alias("total"))


@query(DAYS)
def stream_business_day(spark, sf_dir):
    """The same by a stream run to its end."""
    out = stream.drained(stream.business_days(stream.event_stream(spark, sf_dir)), ["day", "event_type"])
    return out.withColumn("total", F.col("total").cast(D))


@query("SELECT count(*) AS n, count(DISTINCT user_id || event_type || CAST(CAST(ts AS DATE) AS VARCHAR)) AS n_keys FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS ts FROM events)")
def stream_dedup(spark, sf_dir):
    """Lines that arrive again on the same day for the same user and kind count once."""
    rows = stream.event_stream(spark, sf_dir).select(F.to_date("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.to_date("ts").alias("day"))
    out = stream.drained(stream.once(rows, ["user_id", "event_type", "day"]))
    return out.agg(F.count("*").alias("n"), F.count_distinct(F.concat(F.col("user_id").cast("string"), "event_type", F.col("day").cast("string"))).alias("n_keys"))


@query("""
WITH old AS (SELECT product, day, quantity, revenue FROM till_days WHERE day < DATE '2024-01-20'), new AS (SELECT product, day, quantity * 2 AS quantity, revenue FROM till_days WHERE day >= DATE '2024-01-15' AND product <> 'error'),
u AS (SELECT * FROM old WHERE day NOT IN (SELECT DISTINCT day FROM new) UNION ALL SELECT * FROM new) SELECT product, day, quantity, CAST(revenue AS DOUBLE) AS revenue FROM u
""")
def replace_day_upsert(spark, sf_dir):
    """A new file replaces its days whole: what it no longer has on them goes."""
    rows = views.till_days(spark, sf_dir)
    old, new = rows.filter("day < date'2024-01-20'"), rows.filter("day >= date'2024-01-15' and product != 'error'").withColumn("quantity", F.col("quantity") * 2)
    out = old.join(new.select("day").distinct(), "day", "left_anti").select("product", "day", "quantity", "revenue").unionByName(new)
    return out.withColumn("revenue", F.col("revenue").cast(D))


@query("""
WITH old AS (SELECT product, day, quantity, revenue FROM till_days WHERE day < DATE '2024-01-20'), new AS (SELECT product, day, quantity + 1 AS quantity, CASE WHEN product = 'click' THEN NULL ELSE revenue END AS revenue FROM till_days WHERE day >= DATE '2024-01-15')
SELECT coalesce(o.product, n.product) AS product, coalesce(o.day, n.day) AS day, coalesce(n.quantity, o.quantity) AS quantity, CAST(coalesce(n.revenue, o.revenue) AS DOUBLE) AS revenue FROM old o FULL JOIN new n ON o.product = n.product AND o.day = n.day
""")
def partial_upsert(spark, sf_dir):
    """New values by key; money stays as it was where the new file has none."""
    rows = views.till_days(spark, sf_dir)
    old = rows.filter("day < date'2024-01-20'")
    new = rows.filter("day >= date'2024-01-15'").select("product", "day", (F.col("quantity") + 1).alias("new_quantity"), F.when(F.col("product") != "click", F.col("revenue")).alias("new_revenue"))
    out = old.join(new, ["product", "day"], "full")
    return out.select("product", "day", F.coalesce("new_quantity", "quantity").alias("quantity"), F.coalesce("new_revenue", "revenue").cast(D).alias("revenue"))


@query("SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_type, 'all') AS type, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_brand_type(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("decimal(12,2)")).cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("price").cast(D).alias("total"))
    return rows.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_type", F.lit("all")).alias("type"), "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(DISTINCT s) AS n_sessions, count(*) AS n_events FROM s GROUP BY 1
""")
def session_windows(spark, sf_dir):
    """Sessions that end after two idle hours."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = rows.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("""
WITH w AS (SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS first_day, event_type, value FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k)) SELECT CAST(first_day AS DATE) AS first_day, event_type, count(*) AS n FROM w GROUP BY 1, 2
""")
def sliding_windows(spark, sf_dir):
    """Weeks that begin every day; days are counted first, so that seven rows a day are spread and not seven an event."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_sub("day", k))).alias("first_day"), "event_type", "n").groupBy("first_day", "event_type").agg(F.sum("n").alias("n"))


@query("""
WITH s AS (SELECT o_custkey AS customer, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1), n AS (SELECT c_nationkey AS nation, customer, spend FROM s JOIN customer ON c_custkey = customer)
SELECT nation, customer, spend, CAST(ntile(4) OVER (PARTITION BY nation ORDER BY spend DESC, customer) AS INTEGER) AS quarter FROM n
""")
def ntile_spend(spark, sf_dir):
    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast(D).alias("spend"))
    rows = spend.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")), "customer")
    return rows.withColumn("quarter", F.ntile(4).over(Window.partitionBy("nation").orderBy(F.desc("spend"), "customer")))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query("""
WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT day FROM lines) SELECT 'both' AS side, count(*) AS n, min(day) AS first_day FROM (SELECT day FROM a INTERSECT SELECT day FROM b)
UNION ALL SELECT 'orders', count(*), min(day) FROM (SELECT day FROM a EXCEPT SELECT day FROM b) UNION ALL SELECT 'lines', count(*), min(day) FROM (SELECT day FROM b EXCEPT SELECT day FROM a)
""")
def days_covered(spark, sf_dir):
    """Days that both sides read, and those that only one does."""
    a, b = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), views.lines(spark, sf_dir).select("day").distinct()
    side = lambda df, name: df.agg(F.count("*").alias("n"), F.min("day").alias("first_day")).select(F.lit(name).alias("side"), "n", "first_day")
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "orders")).unionByName(side(b.subtract(a), "lines"))


@query("""
WITH b AS (SELECT line_id, account, CASE WHEN account LIKE '1-%' THEN 'urgent' WHEN account LIKE '%SPEC%' THEN 'open' WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS kind FROM bank_lines)
SELECT account, kind, count(*) AS n FROM b GROUP BY 1, 2
""")
def bank_rules(spark, sf_dir):
    """Ordered rules over a line, the first that matches wins."""
    rules = (("^1-", None, "urgent"), ("SPEC", None, "open"), (None, 1, "credit"), (None, -1, "debit"))
    kind = F.lit(None).cast("string")
    for pattern, sign, name in reversed(rules):
        fits = F.col("account").rlike(pattern) if pattern else F.lit(True)
        fits = fits & ((F.col("amount") > 0) if sign == 1 else (F.col("amount") <= 0)) if sign else fits
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    return views.bank_lines(spark, sf_dir).select("account", kind.alias("kind")).groupBy("account", "kind").agg(F.count("*").alias("n"))
