"""Queries by rules that are data: what a bank line is, and what a slip says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import rules
from ledgerloom.sources import views
from ledgerloom.sources.tables import table

from .registry import query

#: A rule for each region: its pattern, its sign and what it says.
PATTERNS = (
    (r"^CB (?P<card>\d+) (?P<day>\d\d)/(?P<month>\d\d) 1-", "debit", "card"), (r"^CB (?P<card>\d+) .* (?P<level>LOW|HIGH)$", None, "level"), (r"MEDIUM (?P<what>\w+)?$", "credit", "medium"),
    (r"^CB \d*7 ", "debit", "seven"), (r"(?P<digit>\d)(?P=digit) ", None, "twice"),
)
LABELS = "l AS (SELECT line_id, amount, 'CB ' || payee_id || ' ' || strftime(day, '%d/%m') || ' ' || replace(account, 'MEDIUM', CASE WHEN line_id % 2 = 0 THEN 'MEDIUM' ELSE 'MEDIUM ' || 'x' || line_id END) AS label FROM bank_lines)"


@query(f"""
WITH {LABELS} SELECT line_id, rule_id, CASE rule_id WHEN 0 THEN 'card' WHEN 1 THEN 'level' WHEN 2 THEN 'medium' WHEN 3 THEN 'seven' WHEN 4 THEN 'twice' END AS category,
  CASE rule_id WHEN 0 THEN regexp_extract(label, '^CB (\\d+)', 1) || '/' || regexp_extract(label, '(\\d\\d)/\\d\\d ', 1) || '/' || regexp_extract(label, '\\d\\d/(\\d\\d) ', 1) WHEN 1 THEN regexp_extract(label, '^CB (\\d+)', 1) || '/' || regexp_extract(label, '(LOW|HIGH)$', 1) WHEN 2 THEN nullif(regexp_extract(label, 'MEDIUM (\\w+)?$', 1), '')
    WHEN 4 THEN regexp_extract(label, '(00|11|22|33|44|55|66|77|88|99) ', 1)[1] END AS captured
FROM (SELECT *, CAST(CASE WHEN amount < 0 AND regexp_matches(label, '^CB \\d+ \\d\\d/\\d\\d 1-') THEN 0 WHEN regexp_matches(label, '^CB \\d+ .* (LOW|HIGH)$') THEN 1 WHEN amount > 0 AND regexp_matches(label, 'MEDIUM (\\w+)?$') THEN 2 WHEN amount < 0 AND regexp_matches(label, '^CB \\d*7 ') THEN 3 WHEN regexp_matches(label, '(00|11|22|33|44|55|66|77|88|99) ') THEN 4 END AS BIGINT) AS rule_id FROM l) AS q
""")
def rule_captures(spark, sf_dir):
    """The first rule of a table that fits each bank line, and what its named groups took."""
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PATTERNS)), (F.col("r_regionkey") + 1).cast("int"))
    read = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rule_id"), F.col("r_regionkey").alias("precedence"), pick(0).alias("pattern"), pick(1).alias("sign"), pick(2).alias("category"))
    i = F.col("line_id")
    account = F.replace("account", F.lit("MEDIUM"), F.when(i % 2 == 0, F.lit("MEDIUM")).otherwise(F.concat(F.lit("MEDIUM x"), i.cast("string"))))
    rows = views.bank_lines(spark, sf_dir).select("line_id", "amount", F.concat_ws(" ", F.lit("CB"), F.col("payee_id").cast("string"), F.date_format("day", "dd/MM"), account).alias("label"))
    out = rules.first_match(rows, read, F.col("label"), F.col("amount"))
    got = F.array_join(F.filter(F.array(*(F.col("rule.captures")[n] for n in ("card", "day", "month", "level", "what", "digit"))), lambda x: x.isNotNull()), "/")
    return out.select("line_id", "rule.rule_id", "rule.category", F.nullif(got, F.lit("")).alias("captured"))


FORMAT = rules.SlipFormat(r"^== (?P<section>DELIVERED|RETURNED)", r"^--", r"^(?P<code>P\d+) .* x(?P<quantity>\d+(?:,\d+)?)$", r"^Sum (?P<total>\d+)$", r"Ref\.? (?P<reference>FA-\d+)")


def _slips(spark, sf_dir):
    """A slip an invoice: what was delivered and returned, each with its sum (every ninth one off), and a reference behind."""
    lines = views.lines(spark, sf_dir)
    back = F.col("flag") == "R"
    item = F.concat(F.lit("P"), F.col("product_id").cast("string"), F.lit(" some words x"), F.col("quantity").cast("int").cast("string"))
    per = lines.groupBy("invoice_id").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("line", "product_id", item.alias("t"))))), lambda x: x["t"]), "\n").alias(n) for n, on in (("d", ~back), ("r", back))), *(F.coalesce(F.sum(F.when(on, F.col("quantity"))), F.lit(0)).cast("int").alias(n) for n, on in (("nd", ~back), ("nr", back))))
    i = F.col("invoice_id")
    text = F.concat_ws("\n", F.concat(F.lit("Slip "), i.cast("string")), F.lit("P1 before any section x9"), F.lit("== DELIVERED goods"), "d", F.concat(F.lit("Sum "), (F.col("nd") + F.when(i % 9 == 0, 1).otherwise(0)).cast("string")), F.when(i % 2 == 0, "-- end"), F.lit("== RETURNED empties"), "r", F.when(i % 3 == 0, F.concat(F.lit("Sum "), F.col("nr").cast("string"))), F.lit("-- end"), F.lit("P2 behind x5"), F.concat(F.lit("your Ref. FA-"), (i + 7).cast("string")))
    return per.select(i.alias("slip_id"), text.alias("text"))


@query("""
WITH s AS (SELECT invoice_id AS slip_id, 1 AS number, 'DELIVERED' AS section, count(*) FILTER (WHERE flag <> 'R') AS n_items, sum(quantity) FILTER (WHERE flag <> 'R') AS quantity, coalesce(sum(quantity) FILTER (WHERE flag <> 'R'), 0) + CASE WHEN invoice_id % 9 = 0 THEN 1 ELSE 0 END AS printed FROM lines GROUP BY 1
UNION ALL SELECT invoice_id, 2, 'RETURNED', count(*) FILTER (WHERE flag = 'R'), sum(quantity) FILTER (WHERE flag = 'R'), CASE WHEN invoice_id % 3 = 0 THEN coalesce(sum(quantity) FILTER (WHERE flag = 'R'), 0) END FROM lines GROUP BY 1)
SELECT slip_id, CAST(number AS BIGINT) AS number, section, n_items, CAST(quantity AS DOUBLE) AS quantity, CAST(printed AS DOUBLE) AS printed, coalesce(quantity, 0) = printed AS agrees, 'FA-' || (slip_id + 7) AS reference FROM s WHERE n_items > 0 OR printed IS NOT NULL
""")
def slip_reading(spark, sf_dir):
    """Slips read by patterns that are data: sections, their items and sums, and what they refer to."""
    read = rules.slip_lines(_slips(spark, sf_dir), FORMAT)
    refs = read.filter("kind = 'reference'").select("slip_id", F.col("captures")["reference"].alias("reference"))
    out = rules.slip_sections(read, "quantity").join(refs, "slip_id", "left")
    return out.select("slip_id", F.col("number").cast("long").alias("number"), "section", "n_items", F.col("quantity").cast("double").alias("quantity"), F.col("printed").cast("double").alias("printed"), "agrees", "reference")
