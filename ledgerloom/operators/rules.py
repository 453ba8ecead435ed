"""Rules as data: patterns with named groups, the first that matches and what it captured; documents read by such patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules that one pass tries; a table with more is refused, since each is an expression.
MOST_RULES = 500


def pattern_of(text: str) -> tuple[str, dict[str, int]]:
    """A user's pattern as Spark reads it, and the number of each of its named groups. One that does not compile raises."""
    names = dict(re.compile(text).groupindex)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m.group(1)]}", re.sub(r"\(\?P<\w+>", "(", text)), names


def captures(text: Column, pattern: str) -> Column:
    """map of the pattern's named groups in the text, those that took no part null."""
    java, names = pattern_of(pattern)
    if not names:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.nullif(F.regexp_extract(text, java, i), F.lit("")) for i in names.values())))


def first_match(rows: DataFrame, rules: DataFrame, text: Column, amount: Column) -> DataFrame:
    """``rows`` with ``rule`` (rule_id, category, captures) of the first rule by precedence, then id, that matches, else null.

    ``rules``: rule_id, precedence, pattern, sign (``debit``, ``credit``, or null for either), category; read once, at most
    ``MOST_RULES``. All are tried in one pass over the rows, nothing is shuffled. A null text matches nothing.
    """
    table = rules.orderBy("precedence", "rule_id").limit(MOST_RULES + 1).collect()
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule_id:bigint,category:string,captures:map<string,string>>")
    for r in reversed(table):
        wanted = text.rlike(pattern_of(r.pattern)[0])
        wanted &= {"debit": amount < 0, "credit": amount > 0}.get(r.sign, F.lit(True))
        found = F.when(wanted, F.struct(F.lit(r.rule_id).cast("bigint").alias("rule_id"), F.lit(r.category).alias("category"), captures(text, r.pattern).alias("captures"))).otherwise(found)
    return rows.withColumn("rule", found)


@dataclass(frozen=True)
class SlipFormat:
    """How a kind of slip reads: patterns of the lines that open a section (group ``section``, or none) and close one, of an item
    inside a section, of a section's printed total (group ``total``), and of a reference (group ``reference``) anywhere."""

    opens: str
    closes: str
    item: str
    total: str
    reference: str


def slip_lines(slips: DataFrame, fmt: SlipFormat) -> DataFrame:
    """(slip_id, at, kind, section, number, captures): what each line of the slips says: an ``item``, a ``total``, a ``reference``.

    ``slips``: slip_id, text. A slip is a state machine over its lines, as two running values: how many sections were opened,
    and whether the last mark opened one. Items and totals count inside a section only; a section that another one follows
    is closed by it. Lines that match nothing, and slips without text, give no rows.
    """
    lines = slips.select("slip_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line"))
    opens, closes = pattern_of(fmt.opens), pattern_of(fmt.closes)
    mark = F.when(F.col("line").rlike(opens[0]), True).when(F.col("line").rlike(closes[0]), False)
    named = F.regexp_extract("line", opens[0], opens[1]["section"]) if "section" in opens[1] else F.lit(None).cast("string")
    upto = Window.partitionBy("slip_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("mark", mark).withColumn("open", F.last("mark", ignorenulls=True).over(upto)).withColumn("number", F.sum(F.coalesce(F.col("mark"), F.lit(False)).cast("int")).over(upto))
    rows = rows.withColumn("section", F.last(F.when(F.col("mark"), named), ignorenulls=True).over(upto))
    inside = F.coalesce(F.col("open"), F.lit(False)) & F.col("mark").isNull()
    says = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), captures(F.col("line"), pattern).alias("captures"))
    fits = lambda pattern: F.col("line").rlike(pattern_of(pattern)[0])
    said = F.when(inside & fits(fmt.total), says("total", fmt.total)).when(inside & fits(fmt.item), says("item", fmt.item)).when(fits(fmt.reference), says("reference", fmt.reference))
    out = rows.withColumn("said", said).filter("said is not null")
    inner = F.col("said.kind") != "reference"
    return out.select("slip_id", "at", "said.kind", F.when(inner, F.col("section")).alias("section"), F.when(inner, F.col("number")).alias("number"), "said.captures")


def slip_sections(read: DataFrame, quantity: str, total: str = "total") -> DataFrame:
    """(slip_id, number, section, n_items, quantity, printed, agrees): each section of ``slip_lines``, its items' quantities added up,
    and whether they are what it prints (null where it prints none)."""
    value = lambda name: F.regexp_replace(F.col("captures")[name], ",", ".").try_cast("decimal(18,3)")
    per = read.filter("kind <> 'reference'").groupBy("slip_id", "number", "section").agg(F.count_if(F.col("kind") == "item").alias("n_items"), F.sum(F.when(F.col("kind") == "item", value(quantity))).alias("quantity"), F.max(F.when(F.col("kind") == "total", value(total))).alias("printed"))
    return per.withColumn("agrees", F.coalesce("quantity", F.lit(0)) == F.col("printed"))


def group_names(patterns: Sequence[str]) -> list[str]:
    """All names that the patterns capture, sorted."""
    return sorted({n for p in patterns for n in pattern_of(p)[1]})
