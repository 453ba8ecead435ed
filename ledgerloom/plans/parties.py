"""Queries over who is on the other side: payees, customers, what a credit is, senders of documents, names that say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.text import identifiers
from ledgerloom.operators import identifiers as ids, matching, names, payees, products, settling
from ledgerloom.sources import views
from ledgerloom.sources.scratch import written
from ledgerloom.sources.tables import table

from .registry import query

D = "double"

#: A word of letters for each supplier, and what the bank prints for those it pays: its word, that word with a letter missing, an
#: alias, or nothing but a label.
PARTIES = """
suppliers AS (SELECT s_suppkey AS supplier_id, translate(upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8)), '0123456789ABCDEF', 'GHIJKLMNOPQRSTUV') AS word FROM supplier),
debits AS (SELECT line_id, -amount AS due, payee_id % 97 AS s, translate(upper(substr(md5(CAST(payee_id % 97 AS VARCHAR)), 1, 8)), '0123456789ABCDEF', 'GHIJKLMNOPQRSTUV') AS w FROM bank_lines WHERE amount < 0),
said AS (SELECT line_id, due, s, line_id % 5 = 4 AS from_label, CASE line_id % 5 WHEN 0 THEN 'S.A.S. ' || lower(w) WHEN 1 THEN 'CARTE/' || substr(w, 1, 3) || substr(w, 5) WHEN 2 THEN 'ALIAS-' || s WHEN 3 THEN 'CB ' || (line_id % 1000) || ' MAISON' ELSE 'FRAIS N S' || ' ' || w END AS payee FROM debits)
"""


def _word(n):
    return F.translate(F.upper(F.substring(F.md5(n.cast("string")), 1, 8)), "0123456789ABCDEF", "GHIJKLMNOPQRSTUV")


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.concat(F.lit("Société "), F.lower(_word(F.col("s_suppkey"))), F.lit(" SARL")).alias("name"))


def _said(spark, sf_dir):
    s, k = F.col("payee_id") % 97, F.col("line_id") % 5
    w = _word(s)
    printed = (
        F.when(k == 0, F.concat(F.lit("S.A.S. "), F.lower(w))).when(k == 1, F.concat(F.lit("CARTE/"), F.substring(w, 1, 3), F.substring(w, 5, 8))).when(k == 2, F.concat(F.lit("ALIAS-"), s.cast("string")))
        .when(k == 3, F.concat(F.lit("CB "), (F.col("line_id") % 1000).cast("string"), F.lit(" MAISON"))).otherwise("")
    )
    label = F.concat(F.lit("Frais N° "), F.col("line_id").cast("string"), F.lit(" s"), F.lit(" "), F.lower(w))
    rows = views.bank_lines(spark, sf_dir).filter("amount < 0")
    return rows.select("line_id", "day", (-F.col("amount")).alias("due"), s.alias("s"), (k == 4).alias("from_label"), payees.payee_of(printed, label).alias("payee"))


def _named(spark, sf_dir, said=None):
    aliases = _suppliers(spark, sf_dir).filter("supplier_id % 2 = 0").select("supplier_id", F.concat(F.lit("alias "), F.col("supplier_id").cast("string")).alias("alias"))
    return payees.named(said or _said(spark, sf_dir), _suppliers(spark, sf_dir), aliases)


NAMED = """
named AS (SELECT DISTINCT line_id, supplier_id, CASE line_id % 5 WHEN 2 THEN 'alias' WHEN 0 THEN 'word' ELSE 'near' END AS how FROM said JOIN suppliers ON (line_id % 5 = 2 AND s = supplier_id AND supplier_id % 2 = 0)
  OR (line_id % 5 = 0 AND lower(word) = substr(payee, 8)) OR (line_id % 5 = 1 AND levenshtein(word, substr(payee, 7)) <= 1))
"""


@query(f"""
WITH {PARTIES}, {NAMED} SELECT supplier_id, how, count(*) AS n_lines, CAST(sum(due) AS DOUBLE) AS due FROM named JOIN said USING (line_id) GROUP BY 1, 2
""")
def payee_suppliers(spark, sf_dir):
    """Payments by the supplier that their payee names: by an alias, a word of its name, or one a letter off."""
    rows = _said(spark, sf_dir).join(_named(spark, sf_dir), ["payee", "from_label"])
    return rows.groupBy("supplier_id", "how").agg(F.count("*").alias("n_lines"), F.sum("due").cast(D).alias("due"))


@query(f"""
WITH {PARTIES}, {NAMED}, totals AS (SELECT invoice_id, sum(ht) AS total FROM lines GROUP BY 1), links AS (SELECT d.line_id, s AS supplier_id, total, CASE WHEN d.line_id % 4 = 0 THEN total + 1 ELSE total END AS due FROM debits d JOIN totals ON invoice_id = d.line_id)
SELECT l.supplier_id, CASE l.line_id % 5 WHEN 1 THEN 'CARTE ' || substr(payee, 7) WHEN 2 THEN 'ALIAS ' || s WHEN 3 THEN 'CB ' || (l.line_id % 1000) || ' MAISON' ELSE payee END AS alias, count(*) AS n_lines
FROM links l JOIN said USING (line_id) WHERE l.due = total AND NOT EXISTS (SELECT 1 FROM named n WHERE n.line_id = l.line_id AND n.supplier_id = l.supplier_id) AND l.line_id % 5 <> 0 GROUP BY 1, 2
UNION ALL SELECT l.supplier_id, 'SAS ' || upper(substr(payee, 8)), count(*) FROM links l JOIN said USING (line_id) WHERE l.due = total AND l.line_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM named n WHERE n.line_id = l.line_id AND n.supplier_id = l.supplier_id) GROUP BY 1, 2
""")
def payee_aliases(spark, sf_dir):
    """Names that payments teach for a supplier, from links whose invoices come to exactly what was paid."""
    totals = views.lines(spark, sf_dir).groupBy(F.col("invoice_id").alias("line_id")).agg(F.sum("ht").alias("invoice_total"))
    due = F.when(F.col("line_id") % 4 == 0, F.col("invoice_total") + 1).otherwise(F.col("invoice_total"))
    links = _said(spark, sf_dir).join(totals, "line_id").select("line_id", due.alias("amount_due"), "payee", "from_label", F.col("s").alias("supplier_id"), "invoice_total")
    return payees.learnt_aliases(links, _named(spark, sf_dir))


@query("""
WITH totals AS (SELECT invoice_id, sum(ht) AS to_pay FROM lines GROUP BY 1), credits AS (SELECT line_id, payee_id FROM bank_lines WHERE amount > 0), docs AS (SELECT invoice_id AS document_id, to_pay, o_custkey % 60 AS customer FROM totals JOIN orders ON o_orderkey = invoice_id),
links AS (SELECT line_id, document_id FROM credits JOIN docs ON document_id = line_id UNION ALL SELECT line_id, document_id FROM credits JOIN docs ON document_id = line_id + 1 WHERE line_id % 6 = 0),
paid AS (SELECT line_id, coalesce(to_pay, 0) + CASE WHEN line_id % 5 = 0 THEN 1 ELSE 0 END AS amount FROM credits LEFT JOIN docs ON document_id = line_id),
used AS (SELECT DISTINCT line_id FROM links), tied AS (SELECT line_id AS k FROM links WHERE document_id = line_id + 1),
g AS (SELECT line_id, document_id, CASE WHEN document_id % 6 = 1 AND document_id - 1 IN (SELECT k FROM tied) THEN document_id - 1 ELSE document_id END AS grp FROM links),
a AS (SELECT grp, sum(amount) AS amount FROM (SELECT DISTINCT grp, line_id FROM g) JOIN paid USING (line_id) GROUP BY 1), b AS (SELECT grp, sum(to_pay) AS to_pay FROM (SELECT DISTINCT grp, document_id FROM g) JOIN docs USING (document_id) GROUP BY 1), good AS (SELECT grp FROM a JOIN b USING (grp) WHERE amount = to_pay),
payers AS (SELECT DISTINCT grp, CASE WHEN line_id % 3 = 0 THEN 'L' || payee_id % 400 ELSE 'P' || payee_id % 40 END AS payer FROM g JOIN good USING (grp) JOIN credits USING (line_id)), customers AS (SELECT DISTINCT grp, 'C' || customer AS customer FROM g JOIN good USING (grp) JOIN docs USING (document_id)),
taught AS (SELECT DISTINCT customer, payer FROM payers JOIN customers USING (grp))
SELECT customer, payer FROM taught WHERE payer LIKE 'P%' OR payer IN (SELECT payer FROM taught GROUP BY 1 HAVING count(*) = 1)
""")
def customer_payers(spark, sf_dir):
    """Payers that links of credits to sales documents teach, group by group of links that adds up."""
    docs = views.lines(spark, sf_dir).groupBy(F.col("invoice_id").alias("document_id")).agg(F.sum("ht").alias("to_pay"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("C"), (F.col("o_custkey") % 60).cast("string")).alias("customer"))
    i, p = F.col("credit_id"), F.col("payee_id")
    credits = views.bank_lines(spark, sf_dir).filter("amount > 0").select(F.col("line_id").alias("credit_id"), "payee_id")
    credits = credits.join(docs.select(F.col("document_id").alias("credit_id"), F.col("to_pay").alias("own")), "credit_id", "left")
    credits = credits.select("credit_id", (F.coalesce("own", F.lit(0)) + F.when(i % 5 == 0, 1).otherwise(0)).alias("amount"), (i % 3 == 0).alias("from_label"), F.when(i % 3 == 0, F.concat(F.lit("L"), (p % 400).cast("string"))).otherwise(F.concat(F.lit("P"), (p % 40).cast("string"))).alias("payer"))
    linked = credits.withColumn("document_id", F.explode(F.when(i % 6 == 0, F.array(i, i + 1)).otherwise(F.array(i))))
    return payees.learnt_payers(linked.join(docs, "document_id").join(owners, "document_id"))


#: What the till compares, what can be chosen for a credit, and the rules on its label.
COMPARED, CHOSEN = ("card", "voucher"), ("card", "voucher", "sale", "no_sale", "loan")
RULES = (("URGENT", "card"), ("LOW", "no_sale"), ("HIGH|URGENT", "voucher"))


@query("""
WITH c AS (SELECT line_id, account, payee_id, amount, CASE WHEN line_id % 17 = 0 THEN 'loan' WHEN line_id % 17 = 1 THEN 'spoilt' END AS choice, CASE payee_id % 11 WHEN 0 THEN 'voucher' WHEN 1 THEN 'no_sale' END AS learnt FROM bank_lines WHERE amount > 0),
s AS (SELECT DISTINCT invoice_id FROM lines WHERE flag = 'R'), r AS (SELECT *, invoice_id IS NOT NULL AS sold, CASE WHEN account LIKE '%URGENT%' THEN 'card' WHEN account LIKE '%LOW%' THEN 'no_sale' WHEN account LIKE '%HIGH%' THEN 'voucher' END AS rule FROM c LEFT JOIN s ON invoice_id = line_id),
x AS (SELECT *, CASE WHEN choice = 'loan' THEN 'loan' WHEN rule IS NOT NULL THEN rule WHEN learnt = 'voucher' THEN 'voucher' WHEN sold THEN 'sale' WHEN learnt IS NOT NULL THEN learnt ELSE 'other' END AS source, CASE WHEN choice = 'loan' THEN 'line' WHEN rule IS NOT NULL THEN 'rule' WHEN learnt = 'voucher' THEN 'payer' WHEN sold THEN 'sale' WHEN learnt IS NOT NULL THEN 'payer' ELSE 'rule' END AS "by" FROM r)
SELECT source, "by", count(*) AS n_lines, min(line_id) AS first_line, CAST(sum(amount) AS DOUBLE) AS amount FROM x GROUP BY 1, 2
""")
def income_readings(spark, sf_dir):
    """What each credit is and who said so: the line, a rule, a payer, a sale it pays."""
    i, p = F.col("line_id"), F.col("payee_id")
    rows = views.bank_lines(spark, sf_dir).filter("amount > 0")
    credits = rows.select("line_id", F.col("account").alias("label"), p.alias("payer"), F.when(i % 17 == 0, "loan").when(i % 17 == 1, "spoilt").alias("choice"))
    retained = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("payer"), F.when(F.col("c_custkey") % 11 == 0, "voucher").when(F.col("c_custkey") % 11 == 1, "no_sale").alias("learnt")).filter("learnt is not null")
    sold = views.lines(spark, sf_dir).filter("flag = 'R'").select(F.col("invoice_id").alias("line_id"))
    out = payees.readings(credits, retained, sold, RULES, COMPARED, CHOSEN)
    return out.join(rows.select("line_id", "amount"), "line_id").groupBy("source", "by").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line"), F.sum("amount").cast(D).alias("amount"))


@query("""
WITH docs AS (SELECT l.invoice_id * 1000000 + l.supplier_id AS doc_id, l.invoice_id, l.supplier_id, o_custkey AS customer_id, min(l.day) AS day FROM lines l JOIN orders ON o_orderkey = l.invoice_id GROUP BY 1, 2, 3, 4),
printed AS (SELECT doc_id, supplier_id, day, 'tel:0' || (1 + supplier_id % 5) || lpad(CAST(supplier_id AS VARCHAR), 8, '0') AS identifier FROM docs WHERE invoice_id % 3 <> 0 UNION SELECT doc_id, supplier_id, day, 'tel:06' || lpad(CAST(customer_id % 50 AS VARCHAR), 8, '0') FROM docs UNION SELECT doc_id, supplier_id, day, 'web:shop' || chr(CAST(97 + supplier_id % 26 AS INTEGER)) || '.com' FROM docs WHERE invoice_id % 2 = 0),
own AS (SELECT identifier, min(supplier_id) AS supplier_id, count(*) AS n FROM printed WHERE day < DATE '1998-01-01' GROUP BY 1 HAVING count(DISTINCT supplier_id) = 1), sizes AS (SELECT supplier_id, count(*) AS docs FROM docs WHERE day < DATE '1998-01-01' GROUP BY 1),
known AS (SELECT identifier, o.supplier_id FROM own o JOIN sizes USING (supplier_id) WHERE n >= docs * 0.25),
found AS (SELECT doc_id, min(k.supplier_id) AS supplier_id, string_agg(identifier, ' ' ORDER BY identifier) AS by_ FROM printed p JOIN known k USING (identifier) WHERE day >= DATE '1998-01-01' GROUP BY 1 HAVING count(DISTINCT k.supplier_id) = 1 AND count(*) FILTER (WHERE identifier NOT LIKE 'web:%') > 0)
SELECT doc_id, supplier_id, by_ AS "by" FROM found
""")
def supplier_identifiers(spark, sf_dir):
    """Documents told by the phones and sites they print, as learnt from those filed before 1998."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"))
    docs = views.lines(spark, sf_dir).groupBy("invoice_id", "supplier_id").agg(F.min("day").alias("day")).join(orders, "invoice_id")
    s = F.col("supplier_id")
    pairs = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"\d\d"), F.lit(0)), ".")
    phone = F.when(F.col("invoice_id") % 3 != 0, F.concat(F.lit("Tel. "), pairs(F.concat(F.lit("0"), (1 + s % 5).cast("string"), F.lpad(s.cast("string"), 8, "0"))), F.lit("\n")))
    site = F.when(F.col("invoice_id") % 2 == 0, F.concat(F.lit("https://www.Shop"), F.char(97 + s % 26), F.lit(".com/\n")))
    client = F.concat(F.lit("Client +33 6"), F.substring(F.regexp_replace(F.lpad((F.col("customer_id") % 50).cast("string"), 8, "0"), r"(\d\d)", " $1"), 1, 12))
    # Texts are read once; a column worked out where it is exploded would be worked out again in the filter that Spark infers.
    docs = docs.select((F.col("invoice_id") * 1000000 + s).alias("doc_id"), "supplier_id", "day", F.concat_ws("", phone, site, client).alias("text"))
    docs = written(docs.withColumn("prints", identifiers(F.col("text"))).drop("text"))
    old = F.col("day") < F.lit("1998-01-01").cast("date")
    printed = lambda rows: rows.select("doc_id", F.explode("prints").alias("identifier"))
    known = ids.learnt(printed(docs.filter(old)), docs.filter(old).select("doc_id", "supplier_id", F.lit(False).alias("bare")))
    return ids.recognised(printed(docs.filter(~old)), known)


@query("""
WITH p AS (SELECT product_id, article AS grp, upper(split_part(raw_name, ' ', 1)) AS a, upper(split_part(raw_name, ' ', 2)) AS b FROM products),
w AS (SELECT product_id, grp, a, CASE product_id % 4 WHEN 0 THEN b || 'MAKER' WHEN 1 THEN b || 'MAKERS' WHEN 2 THEN substr(b, 1, 1) || substr(b, 3) || 'MAKER' ELSE substr(b, 1, 3) END AS b FROM p), d AS (SELECT grp, a, b, min(product_id) AS id FROM w GROUP BY 1, 2, 3),
x AS (SELECT p.id AS a_id, q.id AS b_id, p.a AS a1, p.b AS b1, q.a AS a2, q.b AS b2 FROM d p JOIN d q ON p.grp = q.grp AND p.id < q.id),
y AS (SELECT *, a1 = a2 AND (b1 = b2 OR starts_with(b1, b2) OR starts_with(b2, b1) OR (length(b1) >= 7 AND length(b2) >= 7 AND levenshtein(b1, b2) = 1)) AS same, a1 = a2 AND (b1 = b2 OR b1 || 'S' = b2 OR b2 || 'S' = b1) AS sure FROM x)
SELECT a_id, b_id, sure FROM y WHERE same
""")
def paired_names(spark, sf_dir):
    """Products of an article whose names say the same words, in any order, with plurals, short forms and typos."""
    k, a, b = F.col("product_id") % 4, F.split_part("raw_name", F.lit(" "), F.lit(1)), F.split_part("raw_name", F.lit(" "), F.lit(2))
    noun = F.when(k == 0, F.concat(b, F.lit("maker"))).when(k == 1, F.concat(b, F.lit("makers"))).when(k == 2, F.concat(F.substring(b, 1, 1), F.substring(b, 3, 20), F.lit("maker"))).otherwise(F.substring(b, 1, 3))
    name = F.when(F.col("product_id") % 8 >= 4, F.concat(a, F.lit(" "), noun)).otherwise(F.concat(noun, F.lit(", "), a))
    return names.paired(views.products(spark, sf_dir).select(F.col("product_id").alias("id"), F.col("article").alias("grp"), name.alias("name")))


def _named_payments(spark, sf_dir):
    """Debits by every supplier that their payee names, and the invoices of these suppliers."""
    due = (F.ceil(F.col("due") / 60000) * 25).cast("decimal(12,2)").alias("due")
    said = written(_said(spark, sf_dir))
    rows = said.join(_named(spark, sf_dir, said), ["payee", "from_label"])
    payments = rows.select(F.col("line_id").alias("payment_id"), F.col("supplier_id").alias("key"), "day", due, (F.col("line_id") % 3 == 0).alias("card"), F.lit(False).alias("by_label"))
    bills = views.bank_lines(spark, sf_dir).filter("amount > 0")
    total = (F.ceil(F.col("amount") / 60000) * 25).cast("decimal(12,2)").alias("total")
    return payments, bills.select(F.col("line_id").alias("invoice_id"), (F.col("payee_id") % 97).alias("key"), F.when(F.col("line_id") % 19 != 0, F.col("day")).alias("invoice_day"), total, F.lit(True).alias("fresh"))


def _named_credits(spark, sf_dir):
    """Credits of customers, those of every seventh line recognised by the till and left out, and the customers' documents."""
    rows = views.bank_lines(spark, sf_dir).withColumn("cents", (F.ceil(F.abs("amount") / 25000) * 25).cast("decimal(12,2)"))
    i = F.col("line_id")
    credits = rows.filter((F.col("amount") > 0) & (i % 7 != 0)).select(i.alias("payment_id"), F.col("payee_id").alias("key"), "day", F.col("cents").alias("due"), F.lit(False).alias("card"), (i % 11 == 0).alias("by_label"))
    return credits, rows.filter("amount < 0").select(i.alias("invoice_id"), F.col("payee_id").alias("key"), F.col("day").alias("invoice_day"), F.col("cents").alias("total"), (i % 5 != 0).alias("fresh"))


def settle_debits(payments, documents):
    card = F.col("card")
    return settling.settle(payments, documents, F.when(card, matching.CARD[0]).otherwise(matching.OTHER[0]), F.when(card, matching.CARD[1]).otherwise(matching.OTHER[1]))


def settle_credits(credits, documents):
    return settling.settle(credits, documents.filter("total > 0"), F.lit(matching.CREDIT[0]), F.lit(matching.CREDIT[1]))


@query()
def reconcile_debits(spark, sf_dir):
    """The pass over the debits: exact totals and sums, each taking its invoices from those that come later."""
    return settle_debits(*_named_payments(spark, sf_dir))


@query()
def reconcile_credits(spark, sf_dir):
    """The pass over the credits that nothing recognises, against the documents still due."""
    return settle_credits(*_named_credits(spark, sf_dir))


#: Products with a word of their own, and lines that print them: in another case, by number under another name, words turned round
#: and a letter short, a letter off, another size, letters as look-alike digits, and a spelling that only another one reaches.
PRINTED = """
p AS (SELECT p_partkey AS product_id, p_partkey % 20 AS supplier_id, upper(p_name) AS n, p_type AS t, p_size AS z, translate(upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8)), '0123456789ABCDEF', 'GHIJKLMNOPQRSTUV') AS w, CASE WHEN p_partkey % 4 = 0 THEN CAST(3000000000000 + p_partkey AS VARCHAR) ELSE '' END AS ean FROM part),
known AS (SELECT product_id, supplier_id, n || ' ' || t || ' ' || w || ' ' || z AS name, ean FROM p),
printed AS (SELECT product_id AS line_id, supplier_id, CASE product_id % 8 WHEN 0 THEN lower(n || ' ' || t || ' ' || w || ' ' || z) WHEN 4 THEN 'ARTICLE ' || reverse(w) WHEN 2 THEN z || ' ' || substr(w, 1, 4) || substr(w, 6) || ' ' || t || ' ' || n WHEN 3 THEN n || ' ' || t || ' ' || substr(w, 1, 3) || 'Y' || substr(w, 5) || ' ' || z
  WHEN 5 THEN n || ' ' || t || ' ' || w || ' ' || (z + 100) WHEN 6 THEN translate(n || ' ' || t || ' ' || w, 'OIS', '015') || ' ' || z WHEN 7 THEN n || ' ' || t || ' YYY' || substr(w, 4) || ' ' || z ELSE '  ' || n || ' ' || t || ' ' || w || ' ' || z || ' ' END AS name, CASE WHEN product_id % 8 = 4 THEN ean ELSE '' END AS ean FROM p)
"""


def _printed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    p, n, t, z = F.col("p_partkey"), F.upper("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    w = _word(p)
    name = lambda *x: F.concat_ws(" ", *x)
    ean = F.when(p % 4 == 0, (p + 3_000_000_000_000).cast("string")).otherwise("")
    known = part.select(p.alias("product_id"), (p % 20).alias("supplier_id"), name(n, t, w, z).alias("name"), ean.alias("ean"))
    k = p % 8
    said = (
        F.when(k == 0, F.lower(name(n, t, w, z))).when(k == 4, name(F.lit("ARTICLE"), F.reverse(w))).when(k == 2, name(z, F.concat(F.substring(w, 1, 4), F.substring(w, 6, 9)), t, n))
        .when(k == 3, name(n, t, F.concat(F.substring(w, 1, 3), F.lit("Y"), F.substring(w, 5, 9)), z)).when(k == 5, name(n, t, w, (F.col("p_size") + 100).cast("string"))).when(k == 6, name(F.translate(name(n, t, w), "OIS", "015"), z))
        .when(k == 7, name(n, t, F.concat(F.lit("YYY"), F.substring(w, 4, 9)), z)).otherwise(F.concat(F.lit("  "), name(n, t, w, z), F.lit(" ")))
    )
    return part.select(p.alias("line_id"), (p % 20).alias("supplier_id"), said.alias("name"), F.when(k == 4, ean).otherwise("").alias("ean")), known


#: Letters in common of two texts of words, row by row of the usual table, for pairs that edit distance lets through.
ALIKE = r"""
s AS (SELECT line_id, supplier_id, array_to_string(list_sort(string_split(trim(name), ' ')), ' ') AS a, list_sort(regexp_extract_all(name, '\d+')) AS numbers FROM printed WHERE line_id NOT IN (SELECT line_id FROM first)),
k AS (SELECT product_id, supplier_id, array_to_string(list_sort(string_split(name, ' ')), ' ') AS b, list_sort(regexp_extract_all(name, '\d+')) AS numbers FROM known),
near AS (SELECT line_id, product_id, a, b FROM s JOIN k USING (supplier_id, numbers) WHERE 100 * levenshtein(a, b) <= 6 * (length(a) + length(b))),
scored AS (SELECT line_id, product_id, 200.0 * list_reduce(list_concat([list_transform(range(0, length(b) + 1), lambda i: 0)], list_transform(string_split(a, ''), lambda c: [ascii(c)])),
  lambda old, c: list_reduce(list_concat([[0]], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda new, j: list_append(new, CASE WHEN ascii(substr(b, j[1], 1)) = c[1] THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], new[j[1]]) END)))[length(b) + 1] / (length(a) + length(b)) AS score FROM near)
"""


@query(f"""
WITH {PRINTED}, first AS (SELECT line_id, coalesce(min(k.product_id) FILTER (WHERE lower(trim(l.name)) = lower(trim(k.name))), min(k.product_id) FILTER (WHERE l.ean = k.ean AND l.ean <> '')) AS product_id, max(lower(trim(l.name)) = lower(trim(k.name))) AS same
  FROM printed l JOIN known k ON l.supplier_id = k.supplier_id AND (lower(trim(l.name)) = lower(trim(k.name)) OR (l.ean = k.ean AND l.ean <> '')) GROUP BY 1), {ALIKE},
third AS (SELECT line_id, arg_min(product_id, struct_pack(s := -score, p := product_id)) AS product_id FROM scored WHERE score >= 94 GROUP BY 1)
SELECT l.line_id, coalesce(f.product_id, t.product_id) AS product_id, CASE WHEN same THEN 'exact' WHEN f.line_id IS NOT NULL THEN 'ean' WHEN t.line_id IS NOT NULL THEN 'alike' END AS how FROM printed l LEFT JOIN first f ON f.line_id = l.line_id LEFT JOIN third t ON t.line_id = l.line_id
""")
def products_known_by(spark, sf_dir):
    """The product of each printed name by name, number or likeness."""
    return products.known_by(*_printed(spark, sf_dir)).select("line_id", "product_id", "how")


def _half_way(known):
    """Of every eighth product a line half way between its own name and the far spelling."""
    name = F.regexp_replace("name", r" \w\w(\w{6}) (\d+)$", " YY$1 $2")
    return known.filter("product_id % 8 = 7").select((-F.col("product_id")).alias("line_id"), "supplier_id", name.alias("name"), F.lit("").alias("ean"))


@query()
def products_resolved(spark, sf_dir):
    """The same, and misreadings over and over until no more are found."""
    lines, known = _printed(spark, sf_dir)
    return products.resolve(lines.unionByName(_half_way(known)), known).select("line_id", "product_id", "how", "round")
