"""Queries over the rules of single values and small aggregates: amounts, kinds, days, cells, names, shares."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import money, parse
from ledgerloom.functions import text as tx
from ledgerloom.functions import windows as wd
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query

D = "double"


def _dec(x: str, kind: str = "decimal(12,2)"):
    return F.lit(x).cast(kind)


@query("""
WITH v AS (SELECT *, CASE WHEN line % 2 = 0 THEN round(ht * (1 + vat), 2) END AS printed, CASE WHEN line = 1 THEN 1.50 END AS promotion, CASE WHEN line % 4 = 0 THEN quantity - 1 END AS used, CASE WHEN line = 7 THEN -1 ELSE vat END AS rate, ht - 30000 AS off FROM lines)
SELECT invoice_id, CAST(sum(coalesce(printed - coalesce(promotion, 0), ht * (1 + vat))) AS DOUBLE) AS ttc, CAST(sum(CASE WHEN line = 3 THEN 0 WHEN line = 2 THEN ht + 0.5 ELSE ht END) AS DOUBLE) AS cost, CAST(sum(coalesce(used, quantity)) AS DOUBLE) AS consumed,
  CAST(sum(CASE WHEN rate = -1 THEN 1 ELSE 1 + rate END) AS DOUBLE) AS divisors, CAST(sum(CASE WHEN line % 2 = 0 THEN greatest(least(off, 1000), 0) ELSE least(greatest(off, -1000), 0) END) AS DOUBLE) AS held,
  CAST(sum(CASE line % 3 WHEN 0 THEN ht * (1 + vat) WHEN 1 THEN quantity * 2.50 ELSE quantity * 1.75 END) AS DOUBLE) AS sold FROM v GROUP BY 1
""")
def line_amounts(spark, sf_dir):
    """The money rules of a line, summed by invoice."""
    line, ht, vat, q = (F.col(c) for c in ("line", "ht", "vat", "quantity"))
    printed, promotion = F.when(line % 2 == 0, money.cents(ht * (1 + vat))), F.when(line == 1, _dec("1.50"))
    rate = F.when(line == 7, F.lit(-1)).otherwise(vat).cast(money.RATE)
    off = (ht - 30000).cast("decimal(12,2)")
    total = lambda x, name: F.sum(x).cast(D).alias(name)
    return views.lines(spark, sf_dir).groupBy("invoice_id").agg(
        total(money.line_ttc(printed, promotion, ht, vat), "ttc"), total(money.cost_ht(ht, line == 3, F.when(line == 2, _dec("0.5"))), "cost"), total(money.line_consumption(F.when(line % 4 == 0, q - 1), q), "consumed"),
        total(money.vat_divisor(rate), "divisors"), total(money.held(off, F.when(line % 2 == 0, 1000).otherwise(-1000)), "held"),
        total(money.sale_line_total(F.when(line % 3 == 0, ht), vat, q, F.when(line % 3 == 1, _dec("2.50")), _dec("1.75")), "sold"),
    )


@query("""
WITH d AS (SELECT line_id, amount, (['380', '381', '386', '751', ''])[line_id % 5 + 1] AS code, CASE WHEN line_id % 3 <> 0 THEN amount END AS stated, CASE WHEN line_id % 7 = 0 THEN 10.00 END AS payable, CASE WHEN line_id % 2 = 0 THEN 5.00 END AS prepaid FROM bank_lines),
k AS (SELECT *, CASE WHEN code = '381' OR amount < 0 THEN 'credit note' WHEN code = '386' THEN 'deposit' WHEN code IN ('380', '') THEN 'invoice' ELSE 'type ' || code END AS kind FROM d)
SELECT kind, count(*) AS n, CAST(sum(coalesce(payable, coalesce(stated, round(amount * 1.2, 2)) - coalesce(prepaid, 0))) AS DOUBLE) AS to_pay FROM k GROUP BY 1
""")
def document_kinds(spark, sf_dir):
    """What kind each sale document is, and what it asks for."""
    i, amount = F.col("line_id"), F.col("amount")
    code = F.element_at(F.array(*map(F.lit, ("380", "381", "386", "751", ""))), (i % 5 + 1).cast("int"))
    to_pay = money.document_to_pay(F.when(i % 3 != 0, amount), F.when(i % 7 == 0, _dec("10")), F.when(i % 2 == 0, _dec("5")), amount * _dec("1.2", "decimal(3,1)"))
    return views.bank_lines(spark, sf_dir).groupBy(money.kind_label(code, amount).alias("kind")).agg(F.count("*").alias("n"), F.sum(to_pay).cast(D).alias("to_pay"))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, CAST(day - INTERVAL 1 MONTH AS DATE) AS month_before, CAST(day - INTERVAL 13 MONTH AS DATE) AS year_before, CAST(day(last_day(day)) AS INTEGER) AS n_days, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) AS last_month FROM d
""")
def month_arithmetic(spark, sf_dir):
    """Months before a day, and the month around it."""
    day, first = F.col("day"), F.trunc("day", "MM")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", wd.months_before(day, 1).alias("month_before"), wd.months_before(day, 13).alias("year_before"), F.size(wd.month_days(day)).alias("n_days"), F.add_months(first, 1).alias("next_month"), F.add_months(first, -1).alias("last_month"))


@query("""
SELECT event_type, CAST(CASE WHEN hour(ts) >= 6 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) - 2 END AS DATE) AS complete, count(*) AS n, min(CAST(ts AS DATE) - 1) AS by_calendar FROM events GROUP BY 1, 2
""")
def last_complete_days(spark, sf_dir):
    """How far the till was complete at each event."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type", wd.last_complete_day(ts).alias("complete")).agg(F.count("*").alias("n"), F.min(wd.last_complete_day(ts, None)).alias("by_calendar"))


@query("""
WITH m AS (SELECT kind, CASE WHEN line % 3 = 0 THEN day END AS occurred, CASE WHEN line % 3 <> 2 THEN day + 2 END AS invoiced, CAST(day + 5 AS TIMESTAMP) AS typed FROM movements), e AS (SELECT kind, CAST(coalesce(occurred, invoiced, CAST(typed AS DATE)) AS DATE) AS day FROM m)
SELECT kind, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n FROM e WHERE day BETWEEN DATE '1996-03-10' AND DATE '1997-05-20' GROUP BY 1, 2
""")
def movement_days(spark, sf_dir):
    """Movements by the month of their effective day, in a window whose bounds were typed in the wrong order."""
    line, day = F.col("line"), F.col("day")
    of = wd.effective_day(F.when(line % 3 == 0, day), F.when(line % 3 != 2, F.date_add(day, 2)), F.date_add(day, 5).cast("timestamp"))
    rows = views.movements(spark, sf_dir).select("kind", of.alias("day")).filter(wd.closed(F.col("day"), date(1997, 5, 20), date(1996, 3, 10)))
    return rows.groupBy("kind", F.trunc("day", "MM").alias("month")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_orderkey AS order_id, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS place, count(*) OVER () AS n FROM orders)
SELECT order_id, priority, day, place, n - 250 AS hidden FROM o WHERE place <= 250
""")
def page_of_documents(spark, sf_dir):
    """The first page: urgent ones pinned, then newest, and how many it hides. The page is cut first and numbered then."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"))
    order = [F.when(F.col("priority") == "1-URGENT", 0).otherwise(1), F.desc("day"), F.col("order_id")]
    page = rows.orderBy(*order).limit(250).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return page.join(F.broadcast(rows.agg((F.count("*") - 250).alias("hidden"))))


@query("WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT 'é' || lower(p_type) FROM part) SELECT name, row_number() OVER (ORDER BY strip_accents(lower(name)), name) AS place FROM n")
def reading_order(spark, sf_dir):
    """Names as a reader looks for them, accents and case aside; there are as many as kinds of product."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select(F.concat(F.lit("é"), F.lower("p_type")))).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(tx.search_key(F.col("name")), "name")).cast("long"))


#: Spellings that the till knows, and the order in which methods are listed.
METHODS = {"carte": "CB", "cb": "CB", "especes": "Espèces", "cheque": "Chèque"}
METHOD_ORDER = ("CB", "Espèces", "Chèque")


@query("""
WITH p AS (SELECT (['Carte', 'ESPÈCES', 'chèque ', 'cb', 'Bon'])[user_id % 5 + 1] AS printed, CAST(value AS DECIMAL(12,2)) AS v FROM events), c AS (SELECT CASE strip_accents(lower(trim(printed))) WHEN 'carte' THEN 'CB' WHEN 'cb' THEN 'CB' WHEN 'especes' THEN 'Espèces' WHEN 'cheque' THEN 'Chèque' ELSE trim(printed) END AS method, v FROM p),
s AS (SELECT method, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM c GROUP BY 1) SELECT method, n, total, row_number() OVER (ORDER BY coalesce(nullif(list_position(['CB', 'Espèces', 'Chèque'], method), 0), 99), method) AS place FROM s
""")
def payment_methods(spark, sf_dir):
    """Payments by method in the list's own order, whatever a till prints."""
    printed = F.element_at(F.array(*map(F.lit, ("Carte", "ESPÈCES", "chèque ", "cb", "Bon"))), (F.col("user_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").groupBy(tx.spelled(printed, METHODS).alias("method")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast(D).alias("total"))
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, METHOD_ORDER)), F.col("method")), F.lit(0)), F.lit(99))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(at, "method")).cast("long"))


@query("""
WITH c AS (SELECT article, product_id, CASE WHEN product_id % 6 = 0 THEN 0 ELSE CAST(sum(ht) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) END AS cost FROM lines JOIN products USING (product_id) WHERE flag <> 'R' GROUP BY 1, 2)
SELECT article, arg_min(product_id, cost) FILTER (WHERE cost > 0) AS cheapest, count(*) AS n_members FROM c GROUP BY 1
""")
def cheapest_members(spark, sf_dir):
    """Of each article's products the one with the least cost above 0."""
    per = views.lines(spark, sf_dir).filter("flag <> 'R'").groupBy("product_id").agg((F.sum("ht").cast(D) / F.sum("quantity").cast(D)).alias("c")).withColumn("cost", F.when(F.col("product_id") % 6 == 0, 0.0).otherwise(F.col("c")))
    rows = per.join(views.products(spark, sf_dir).select("product_id", "article"), "product_id")
    return rows.groupBy("article").agg(F.min_by("product_id", F.when(F.col("cost") > 0, F.col("cost"))).alias("cheapest"), F.count("*").alias("n_members"))


@query("""
WITH u AS (SELECT product_id, supplier_id, quantity, CASE WHEN line = 5 THEN NULL ELSE round(CAST(ht AS DOUBLE) / CAST(quantity AS DOUBLE), 2) END AS unit FROM lines WHERE flag = 'R')
SELECT product_id, count(*) AS n_lines, CASE WHEN min(unit) = max(unit) AND NOT bool_or(unit IS NULL AND quantity <> 0) THEN min(unit) END AS unit FROM u GROUP BY 1
""")
def agreed_unit_prices(spark, sf_dir):
    """A returned product's unit price, only where every counted line has one and they agree."""
    unit = F.when(F.col("line") != 5, F.round(F.col("ht").cast(D) / F.col("quantity").cast(D), 2))
    rows = views.lines(spark, sf_dir).filter("flag = 'R'").select("product_id", "quantity", unit.alias("unit"))
    agreed = (F.min("unit") == F.max("unit")) & ~F.bool_or(F.col("unit").isNull() & (F.col("quantity") != 0))
    return rows.groupBy("product_id").agg(F.count("*").alias("n_lines"), F.when(agreed, F.min("unit")).alias("unit"))


@query("""
WITH d AS (SELECT DISTINCT article, supplier_id AS store, day FROM lines JOIN products USING (product_id) WHERE flag <> 'R'), s AS (SELECT article, store, count(*) AS n_days FROM d GROUP BY 1, 2)
SELECT article, store, n_days, CAST(n_days AS DOUBLE) / sum(n_days) OVER (PARTITION BY article) AS share FROM s
""")
def store_shares(spark, sf_dir):
    """Of the days that bought an article, the share of each store."""
    days = views.lines(spark, sf_dir).filter("flag <> 'R'").join(views.products(spark, sf_dir).select("product_id", "article"), "product_id").select("article", F.col("supplier_id").alias("store"), "day").distinct()
    per = days.groupBy("article", "store").agg(F.count("*").alias("n_days"))
    return per.withColumn("share", F.col("n_days").cast(D) / F.sum("n_days").over(Window.partitionBy("article")))


@query("""
WITH d AS (SELECT DISTINCT product_id, day FROM lines), g AS (SELECT product_id, CAST(day - lag(day) OVER (PARTITION BY product_id ORDER BY day) AS INTEGER) AS gap FROM d), l AS (SELECT product_id, list_sort(list(gap)) AS a FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT product_id, a[len(a) // 2 + 1] AS high_median, list_median(a) AS middle, list_avg(a) AS mean, round(list_stddev_pop(a), 6) AS spread FROM l
""")
def gap_statistics(spark, sf_dir):
    """Gaps between purchase days: the higher median, the median, mean and spread."""
    days = views.lines(spark, sf_dir).select("product_id", "day").distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("product_id").orderBy("day")))).filter("gap is not null")
    high = F.get(F.array_sort(F.collect_list("gap")), F.floor(F.count("*") / 2).cast("int"))
    return gaps.groupBy("product_id").agg(high.alias("high_median"), F.median("gap").alias("middle"), F.avg("gap").alias("mean"), F.round(F.stddev_pop("gap"), 6).alias("spread"))


@query("""
WITH r AS (SELECT article, category, quantity, ht, CASE WHEN line <> 6 THEN day END AS day FROM lines JOIN products USING (product_id) WHERE flag <> 'R')
SELECT article, CAST(sum(quantity) AS DOUBLE) AS bought, CAST(sum(ht) AS DOUBLE) AS ht, count(*) FILTER (WHERE day IS NULL) AS undated FROM r WHERE category = 'C1' AND (day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' OR day IS NULL) GROUP BY 1
""")
def flagged_purchases(spark, sf_dir):
    """What was bought of flagged articles in a year, undated lines included."""
    day = F.when(F.col("line") != 6, F.col("day"))
    inside = wd.closed(F.col("when"), date(1998, 1, 1), date(1998, 12, 31)) | F.col("when").isNull()
    flagged = views.products(spark, sf_dir).filter("category = 'C1'").select("product_id", "article")
    rows = views.lines(spark, sf_dir).filter("flag <> 'R'").withColumn("when", day).filter(inside).join(flagged, "product_id")
    return rows.groupBy("article").agg(F.sum("quantity").cast(D).alias("bought"), F.sum("ht").cast(D).alias("ht"), F.count_if(F.col("when").isNull()).alias("undated"))


@query("""
WITH i AS (SELECT line_id, payee_id, amount, CASE WHEN line_id % 17 <> 0 THEN day END AS day FROM bank_lines WHERE amount > 0)
SELECT payee_id, count(*) AS n_unpaid, CAST(sum(amount) AS DOUBLE) AS due, count(*) FILTER (WHERE day IS NULL) AS undated FROM i WHERE (day BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' OR day IS NULL) AND NOT EXISTS (SELECT 1 FROM lines WHERE invoice_id = line_id AND flag = 'R') GROUP BY 1
""")
def unpaid_invoices(spark, sf_dir):
    """Invoices that no payment is linked to, dated in the search window or not at all."""
    rows = views.bank_lines(spark, sf_dir).filter("amount > 0").withColumn("when", F.when(F.col("line_id") % 17 != 0, F.col("day")))
    links = views.lines(spark, sf_dir).filter("flag = 'R'").select(F.col("invoice_id").alias("line_id"))
    near = rows.filter(wd.closed(F.col("when"), date(1994, 1, 1), date(1996, 12, 31)) | F.col("when").isNull())
    return near.join(links, "line_id", "left_anti").groupBy("payee_id").agg(F.count("*").alias("n_unpaid"), F.sum("amount").cast(D).alias("due"), F.count_if(F.col("when").isNull()).alias("undated"))


@query("""
WITH w(word, lo, hi) AS (VALUES ('1996', DATE '1996-01-01', DATE '1996-12-31'), ('03/1997', DATE '1997-03-01', DATE '1997-03-31'), ('12/07/1996', DATE '1996-07-12', DATE '1996-07-12'))
SELECT word, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) FILTER (WHERE CAST(o_totalprice AS DECIMAL(12,2)) < 100000) AS n_fit FROM orders, w WHERE CAST(o_orderdate AS DATE) BETWEEN lo AND hi GROUP BY 1
""")
def partial_dates(spark, sf_dir):
    """Documents of a year, a month or a day, as typed, and how many amounts fit a column of seven digits."""
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    words = ("1996", "03/1997", "12/07/1996")
    met = rows.withColumn("word", F.explode(F.array_compact(F.array(*(F.when(parse.of_partial_date(w, F.col("day")), F.lit(w)) for w in words)))))
    return met.groupBy("word").agg(F.count("*").alias("n"), F.sum("amount").cast(D).alias("total"), F.count_if(money.fits(F.col("amount"), 7, 2)).alias("n_fit"))


@query("""
WITH c AS (SELECT event_type, CAST(value * 100 AS DECIMAL(14,2)) AS v, event_id % 1440 AS minutes, CAST(ts AS DATE) AS d, event_id % 3 AS r FROM events)
SELECT event_type, CAST(sum(v) AS DOUBLE) AS amounts, CAST(sum(CAST(minutes // 60 AS DECIMAL(8,2)) + round(CAST(minutes % 60 AS DECIMAL(8,4)) / 60, 2)) AS DOUBLE) AS hours, count(DISTINCT d) AS n_days, CAST(min(d) AS DATE) AS first_day, CAST(max(d) AS DATE) AS last_day, CAST(sum(CASE r WHEN 0 THEN 0.2 WHEN 1 THEN 0.055 ELSE 0.1 END) AS DOUBLE) AS rates FROM c GROUP BY 1
""")
def read_cells(spark, sf_dir):
    """Amounts, hours, days (three ways) and VAT rates written as a till writes them, and read back."""
    i = F.col("event_id")
    v, minutes, d = (F.col("value") * 100).cast("decimal(14,2)"), i % 1440, F.to_date("ts")
    clock = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    rate = F.element_at(F.array(F.lit("20 %"), F.lit("5,5%"), F.lit("0.1")), (i % 3 + 1).cast("int"))
    back = F.when(i % 3 == 0, parse.day(F.date_format(d, "dd/MM/yy"))).when(i % 3 == 1, parse.day(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))).otherwise(parse.day(F.datediff(d, F.lit("1904-01-01").cast("date")).cast("string"), epoch=1904))
    rows = table(spark, sf_dir, "events").select("event_type", money.number(parse.grouped(v)).alias("v"), parse.hours(clock).alias("h"), back.alias("d"), money.vat_rate(rate).alias("r"))
    return rows.groupBy("event_type").agg(F.sum("v").cast(D).alias("amounts"), F.sum("h").cast(D).alias("hours"), F.count_distinct("d").alias("n_days"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.sum("r").cast(D).alias("rates"))


@query("""
WITH j AS (SELECT event_type, (['""', ' [] ', '{}', 'null', '0', 'false', '[1]', '{"a": 1}', 'no json', '" "'])[event_id % 10 + 1] AS j FROM events) SELECT event_type, count(*) FILTER (WHERE j IN ('""', ' [] ', '{}', 'null', 'no json')) AS blank, count(*) AS n FROM j GROUP BY 1
""")
def blank_values(spark, sf_dir):
    """JSON cells that hold nothing."""
    cells = ('""', " [] ", "{}", "null", "0", "false", "[1]", '{"a": 1}', "no json", '" "')
    j = F.element_at(F.array(*map(F.lit, cells)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(tx.is_blank(j)).alias("blank"), F.count("*").alias("n"))


@query("SELECT lang, CAST(sum(length(text) + length(source)) AS BIGINT) AS characters, count(*) AS n FROM documents GROUP BY 1")
def corpus_fingerprint(spark, sf_dir):
    """The length of what a search would read: another one means that the corpus changed."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text") + F.length("source")).alias("characters"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT article, line, supplier_id, quantity, stock_equivalent AS size FROM lines JOIN products USING (product_id) WHERE flag = 'A'), b AS (SELECT article, CASE WHEN supplier_id % 2 = 0 THEN quantity WHEN line % 2 = 0 THEN 0.700 ELSE quantity END AS base, size FROM c)
SELECT article, CAST(sum(base * size) AS DOUBLE) AS counted, count(*) AS n_lines FROM b GROUP BY 1
""")
def counted_stock(spark, sf_dir):
    """Counts of an article in its stock unit, by the piece or by the volume measured, several lines to an article."""
    rows = views.lines(spark, sf_dir).filter("flag = 'A'")
    volume = F.when(F.col("line") % 2 == 0, _dec("0.7", money.QUANTITY)).otherwise(_dec("0", money.QUANTITY))
    per = rows.groupBy("product_id").agg(F.sum(money.base_amount(F.col("supplier_id") % 2 == 0, F.col("quantity"), volume)).alias("q"), F.count("*").alias("n"))
    return per.join(views.products(spark, sf_dir).select("product_id", "article", "stock_equivalent"), "product_id").groupBy("article").agg(F.sum(F.col("q") * F.col("stock_equivalent")).cast(D).alias("counted"), F.sum("n").alias("n_lines"))


@query("""
WITH c AS (SELECT product_id, category, lpad(CAST(product_id * 9973 + 100000007 AS VARCHAR), 12, '3') AS b FROM products), w AS (SELECT product_id, category, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(b[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS digit FROM c)
SELECT category, count(*) FILTER (WHERE (digit + CASE WHEN product_id % 4 = 0 THEN 1 ELSE 0 END) % 10 = digit) AS n_valid, count(*) AS n FROM w GROUP BY 1
""")
def article_numbers(spark, sf_dir):
    """Thirteen-digit article numbers, every fourth with a wrong last digit."""
    base = F.lpad((F.col("product_id") * 9973 + 100000007).cast("string"), 12, "3")
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(base, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    digit = ((10 - odd % 10) % 10 + F.when(F.col("product_id") % 4 == 0, 1).otherwise(0)) % 10
    return views.products(spark, sf_dir).groupBy("category").agg(F.count_if(tx.is_gtin(F.concat(base, digit.cast("string")))).alias("n_valid"), F.count("*").alias("n"))


@query("""
WITH p AS (SELECT product_id, upper(raw_name) AS name, product_id % 5 AS k FROM products) SELECT product_id, name AS stripped FROM p
""")
def names_without_sizes(spark, sf_dir):
    """Names to which sizes and counts were added, stripped again."""
    k = F.col("product_id") % 5
    name = F.when(k == 0, F.concat("raw_name", F.lit(" 6x33cl"))).when(k == 1, F.concat("raw_name", F.lit(" 1,5 L"))).when(k == 2, F.concat("raw_name", F.lit(", 70CL X6"))).when(k == 3, F.concat(F.lit("500G "), "raw_name", F.lit(" 24"))).otherwise(F.col("raw_name"))
    return views.products(spark, sf_dir).select("product_id", tx.without_sizes(name).alias("stripped"))


@query("""
WITH s AS (SELECT product_id, CAST(sum(quantity) AS DOUBLE) AS q, loss_percent FROM lines JOIN products USING (product_id) GROUP BY product_id, loss_percent), r AS (SELECT product_id, q - 500 AS room, q * (1 - loss_percent / 100.0) - 500 AS allowance, 1 + product_id % 7 AS amount FROM s)
SELECT product_id, CAST(CASE WHEN room > 0 THEN floor(room / amount) ELSE 0 END AS BIGINT) AS whole, CAST(CASE WHEN room > 0 AND allowance > 0 AND floor(room / amount) > 0 THEN least(floor(room / amount), ceil(allowance / amount)) ELSE 0 END AS BIGINT) AS within_loss FROM r
""")
def servings_left(spark, sf_dir):
    """Whole servings that what is left of each product makes, and within its normal loss."""
    per = views.lines(spark, sf_dir).groupBy("product_id").agg(F.sum("quantity").cast(D).alias("q")).join(views.products(spark, sf_dir).select("product_id", "loss_percent"), "product_id")
    room, allowance = F.col("q") - 500, F.col("q") * (1 - F.col("loss_percent") / 100) - 500
    whole, within = money.servings(room, allowance, 1 + F.col("product_id") % 7)
    return per.select("product_id", whole.cast("long").alias("whole"), within.cast("long").alias("within_loss"))
