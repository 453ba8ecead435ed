"""Who was paid and who paid: payees that name a supplier, names learnt from links that add up, what a credit is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import search_key
from ledgerloom.operators.graph import components

#: Words that name nobody.
GENERIC_WORDS = (
    "SAS", "SASU", "SARL", "EURL", "SCEA", "EARL", "GAEC", "SNC", "SCI", "SOC", "STE", "SOCIETE", "CIE", "ETS", "ETABLISSEMENTS", "THE", "AND", "LES", "DES", "AUX", "SUR", "PERE", "FILS", "FRERES", "FILLE",
    "MAISON", "DOMAINE", "CHATEAU", "CAVE", "CAVES", "VIGNERONS", "CHAMPAGNE", "FRANCE", "PARIS", "AUTRE", "ANALYSE",
)
#: Fixed value: words this long may be one letter off.
NEAR_LENGTH = 5


def words(text: Column) -> Column:
    """Upper-case words without accents; points inside a word go, other marks part words."""
    parts = F.split(F.upper(search_key(text)), r"[\s/\-*&()+,;:'\"]+")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"[^A-Z0-9]", "")), lambda w: w != "")


def key_of(payee: Column) -> Column:
    return F.array_join(words(payee), " ")


def payee_of(counterparty: Column, label: Column) -> Column:
    """Whom the bank prints; where it prints nobody the label's words without their digits."""
    return F.when(F.trim(F.coalesce(counterparty, F.lit(""))) != "", counterparty).otherwise(key_of(F.regexp_replace(label, r"\d+", " ")))


def named(payees: DataFrame, suppliers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(payee, from_label, supplier_id, how): the suppliers that a payee names by ``alias``, ``word`` or ``near`` word.

    ``payees``: payee, from_label; ``suppliers``: supplier_id, name; ``aliases``: supplier_id, alias. A payee read off a label
    names by alias alone. Distinct words meet distinct words, by themselves and without each of their letters, so a word in a
    third of all payees is looked up once.
    """
    said = payees.select("payee", "from_label").distinct()
    taught = aliases.select("supplier_id", key_of(F.col("alias")).alias("key")).distinct()
    by_alias = said.withColumn("key", key_of(F.col("payee"))).join(taught, "key").select("payee", "from_label", "supplier_id", F.lit(0).alias("rank"))
    said = said.filter(~F.col("from_label")).select("payee", "from_label", F.explode(F.array_distinct(words(F.col("payee")))).alias("word"))
    own = suppliers.select("supplier_id", F.explode(F.array_distinct(words(F.col("name")))).alias("known"))
    own = own.filter((F.length("known") >= 3) & ~F.col("known").rlike(r"^\d+$") & ~F.col("known").isin(*GENERIC_WORDS))
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    keys = lambda c: F.explode(F.array_distinct(F.when(F.length(c) >= NEAR_LENGTH, F.concat(F.array(c), without(F.col(c)))).otherwise(F.array(c)))).alias("key")
    met = said.select("word").distinct().select("word", keys("word")).join(own.select("known").distinct().select("known", keys("known")), "key")
    near = (F.length("word") >= NEAR_LENGTH) & (F.length("known") >= NEAR_LENGTH) & (F.levenshtein("word", "known") <= 1)
    met = met.filter((F.col("word") == F.col("known")) | near).select("word", "known", F.when(F.col("word") == F.col("known"), 1).otherwise(2).alias("rank")).distinct()
    by_word = said.join(met, "word").join(own, "known").select("payee", "from_label", "supplier_id", "rank")
    best = by_alias.unionByName(by_word).groupBy("payee", "from_label", "supplier_id").agg(F.min("rank").alias("rank"))
    return best.select("payee", "from_label", "supplier_id", F.element_at(F.array(*map(F.lit, ("alias", "word", "near"))), F.col("rank") + 1).alias("how"))


def learnt_aliases(links: DataFrame, known: DataFrame) -> DataFrame:
    """(supplier_id, alias, n_lines): what links of payments to invoices teach. ``links``: line_id, amount_due, payee, from_label,
    supplier_id, invoice_total.

    Only a line whose invoices, all of them, come to exactly what left the account teaches, and only a payee that does not
    name the supplier already (``known``, as ``named`` gives).
    """
    even = links.groupBy("line_id").agg(F.sum("invoice_total").alias("paid"), F.first("amount_due").alias("due")).filter("paid = due")
    sure = links.join(even.select("line_id"), "line_id").select("line_id", "payee", "from_label", "supplier_id").distinct()
    new = sure.join(known, ["payee", "from_label", "supplier_id"], "left_anti").withColumn("alias", key_of(F.col("payee"))).filter("alias <> ''")
    return new.groupBy("supplier_id", "alias").agg(F.count_distinct("line_id").alias("n_lines"))


def learnt_payers(links: DataFrame) -> DataFrame:
    """(customer, payer): payers that links of credits to sales documents teach. ``links``: credit_id, amount, payer, from_label,
    document_id, to_pay, customer.

    Credits and documents that links join are one group; its payers are taught to its customers where its credits come to
    exactly what its documents ask. A payer read off a label and taught to two customers names neither.
    """
    credit, document = F.col("credit_id") * 2, F.col("document_id") * 2 + 1
    found = components(links.select(credit.alias("a"), document.alias("b")))
    rows = links.withColumn("node", credit).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    paid = rows.select("root", "credit_id", "amount").distinct().groupBy("root").agg(F.sum("amount").alias("paid"))
    asked = rows.select("root", "document_id", "to_pay").distinct().groupBy("root").agg(F.sum("to_pay").alias("asked"))
    even = rows.join(paid.join(asked, "root").filter("paid = asked").select("root"), "root")
    payers = even.filter("payer <> ''").groupBy("root", "payer").agg(F.max("from_label").alias("from_label"))
    taught = payers.join(even.filter("customer <> ''").select("root", "customer").distinct(), "root").groupBy("customer", "payer").agg(F.max("from_label").alias("from_label"))
    shared = taught.filter("from_label").groupBy("payer").agg(F.count("*").alias("n")).filter("n > 1")
    return taught.join(shared, "payer", "left_anti").select("customer", "payer")


def readings(credits: DataFrame, retained: DataFrame, sold: DataFrame, rules: Sequence[tuple[str, str]], compared: Sequence[str], chosen: Sequence[str]) -> DataFrame:
    """``credits`` (line_id, label, payer, choice) with their ``source`` and who said so (``by``): the line's own choice, else the
    first rule, else a payer retained for a source the till compares, else the sale it pays, else a payer retained for
    another source, else ``other``. ``retained``: payer, learnt; ``sold``: line_id."""
    rule = F.lit(None).cast("string")
    for pattern, source in reversed(rules):
        rule = F.when(F.col("label").rlike(pattern), F.lit(source)).otherwise(rule)
    rows = credits.join(retained.groupBy("payer").agg(F.max("learnt").alias("learnt")), "payer", "left").join(sold.select("line_id", F.lit(True).alias("sold")).distinct(), "line_id", "left")
    said = lambda source, by: F.struct(source.alias("source"), F.lit(by).alias("by"))
    learnt = F.col("learnt")
    reading = (
        F.when(F.col("choice").isin(list(chosen)), said(F.col("choice"), "line")).when(rule.isNotNull(), said(rule, "rule")).when(learnt.isin(list(compared)), said(learnt, "payer"))
        .when(F.col("sold"), said(F.lit("sale"), "sale")).when(learnt.isin(list(chosen)), said(learnt, "payer")).otherwise(said(F.lit("other"), "rule"))
    )
    return rows.withColumn("reading", reading).select("line_id", "reading.source", "reading.by")
