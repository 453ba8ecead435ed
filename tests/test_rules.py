"""Rules and slips read from patterns that are data."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules


def test_patterns():
    assert rules.pattern_of(r"(?P<a>x)(y)(?P<b>z)(?P=a)") == (r"(x)(y)(z)\1", {"a": 1, "b": 3})
    with pytest.raises(re.error):
        rules.pattern_of("(")


def test_first_match(spark):
    rows = spark.createDataFrame([(1, "FEES 12", -1.0), (2, "FEES 12", 1.0), (3, "SHOP aa", -1.0), (4, None, -1.0), (5, "none", 0.0)], "k long, label string, amount double")
    table = [(3, 1, r"SHOP (?P<who>\w)(?P=who)(?P<more>x)?", None, "shop"), (2, 1, r"^FEES (?P<n>\d+)", "debit", "fees"), (1, 2, "FEES", None, "other")]
    read = spark.createDataFrame(table, "rule_id long, precedence int, pattern string, sign string, category string")
    got = {r.k: r.rule and (r.rule.rule_id, r.rule.category, r.rule.captures) for r in rules.first_match(rows, read, F.col("label"), F.col("amount")).collect()}
    assert got == {1: (2, "fees", {"n": "12"}), 2: (1, "other", {}), 3: (3, "shop", {"who": "a", "more": None}), 4: None, 5: None}
    assert all(r.rule is None for r in rules.first_match(rows, read.limit(0), F.col("label"), F.col("amount")).collect())
    with pytest.raises(ValueError):
        rules.first_match(rows, read.crossJoin(spark.range(200)).select(read.columns), F.col("label"), F.col("amount"))


FORMAT = rules.SlipFormat(r"^\[(?P<section>\w+)", r"^\]", r"^(?P<name>\w+) x(?P<quantity>[\d,]+)", r"^= (?P<total>[\d,]+)", r"ref (?P<reference>\w+)")


def test_slips(spark):
    text = "keg x9\n[out\r\nkeg x1,5\nnonsense\nbox x2\n= 3,5\n[back\nkeg x4\n]\nkeg x7\n= 7\nsee ref A1 and\n[empty\n]\n[sum\n= 2"
    slips = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ref B\nref C")], "slip_id long, text string")
    read = rules.slip_lines(slips, FORMAT)
    got = [(r.slip_id, r.at, r.kind, r.section, r.number, r.captures) for r in read.orderBy("slip_id", "at").collect()]
    assert [x[:5] for x in got] == [(1, 2, "item", "out", 1), (1, 4, "item", "out", 1), (1, 5, "total", "out", 1), (1, 7, "item", "back", 2), (1, 11, "reference", None, None), (1, 15, "total", "sum", 4), (4, 0, "reference", None, None), (4, 1, "reference", None, None)]
    assert got[0][5] == {"name": "keg", "quantity": "1,5"} and got[4][5] == {"reference": "A1"}
    sections = {(r.slip_id, r.number): (r.section, r.n_items, None if r.quantity is None else float(r.quantity), None if r.printed is None else float(r.printed), r.agrees) for r in rules.slip_sections(read, "quantity").collect()}
    assert sections == {(1, 1): ("out", 2, 3.5, 3.5, True), (1, 2): ("back", 1, 4.0, None, None), (1, 4): ("sum", 0, None, 2.0, False)}
    assert rules.group_names([FORMAT.item, FORMAT.total]) == ["name", "quantity", "total"]
