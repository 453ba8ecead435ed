"""Queries over sizes and counts in names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import packs as ops
from ledgerloom.sources.tables import table

from .registry import query

#: What is put before and behind a name, the line's pack, quantity and volume, and, by the rules and not by this code, what one
#: unit is worth: before, behind, pack, quantity, volume, unit, equivalent, confidence, approx, stock unit, stripped.
CASES = (
    ("", " 6X33CL", 1, 2, "0", "UNIT", "6", "medium", False, "UNIT", True), ("", " 6X33CL", 6, 12, "0", "UNIT", "1", "high", False, "UNIT", True), ("", " 24X33CL", 1, 24, "7.92", "UNIT", "1", "high", False, "UNIT", True),
    ("", " 30L", 1, 1, "0", "UNIT", "30", "high", False, "L", True), ("", " 10L", 10, 10, "0", "L", "1", "high", False, "L", True), ("", " 70CL", 6, 6, "0", "UNIT", "0.7", "high", False, "L", True),
    ("", " 10GX100", 1, 1, "0", "UNIT", "100", "medium", False, "UNIT", True), ("", " 2,5KGENV", 1, 3, "0", "UNIT", "2.5", "medium", True, "KG", True), ("", " 4/4", 1, 1, "0", "UNIT", "0.85", "medium", True, "KG", True),
    ("VERRE ", " 58CL", 6, 6, "0", "UNIT", "1", "high", False, "UNIT", False), ("", " 20X30CM", 1, 1, "0", "UNIT", "1", "low", False, "UNIT", True), ("MPRO 100", "", 1, 1, "0", "UNIT", "100", "medium", False, "UNIT", True),
    ("1664 ", " 50CL", 1, 1, "0", "UNIT", "0.5", "high", False, "L", False), ("", " 24RLX", 1, 1, "0", "UNIT", "24", "medium", False, "UNIT", True), ("", " 800G", 1, 2, "1.6", "KG", "1", "high", False, "KG", True),
    ("", " X12", 12, 12, "0", "UNIT", "1", "high", False, "UNIT", True),
)
VALUES = ", ".join(f"({i}, '{c[0]}', '{c[1]}', '{c[5]}', {c[6]}::DOUBLE, '{c[7]}', {c[8]}, '{c[9]}', {c[10]})" for i, c in enumerate(CASES))


@query(f"""
WITH c(k, before, behind, unit, equivalent, confidence, approx, stock_unit, gone) AS (VALUES {VALUES})
SELECT product_id, unit, equivalent, confidence, approx, stock_unit, CASE WHEN gone THEN upper(raw_name) WHEN before = '' THEN upper(raw_name || behind) ELSE before || upper(raw_name) END AS stripped FROM products JOIN c ON k = product_id % {len(CASES)}
""")
def pack_quantities(spark, sf_dir):
    """What a unit of each product is worth in stock, from marks of sixteen kinds in its name and its line's figures."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_partkey") % len(CASES)).cast("int").alias("k"))
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in CASES)), F.col("k") + 1)
    rows = rows.select("id", F.concat(pick(0), "p_name", pick(1)).alias("name"), pick(2).alias("pack"), pick(3).alias("quantity"), pick(4).alias("total_volume"))
    out = ops.pack_equivalents(rows).join(rows.select("id", ops.without_packs(F.col("name")).alias("stripped")), "id")
    return out.select(F.col("id").alias("product_id"), "unit", F.col("equivalent").cast("double").alias("equivalent"), "confidence", "approx", "stock_unit", "stripped")
