"""Suppliers told by what their documents print: company numbers, phones and web sites, learnt and looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of its own documents, and the number without its header, that have to print what names a supplier.
LEAST_SHARE, LEAST_BARE = 0.25, 2


def learnt(printed: DataFrame, filed: DataFrame) -> DataFrame:
    """(supplier_id, identifier) that name a supplier: no other's documents print them, and a quarter of its own do, or of its
    own without a header, two at least. ``printed``: doc_id, identifier; ``filed``: doc_id, supplier_id, bare (no header)."""
    sizes = filed.groupBy("supplier_id").agg(F.count("*").alias("docs"), F.count_if("bare").alias("bare_docs"))
    per = printed.distinct().join(filed, "doc_id").groupBy("identifier", "supplier_id").agg(F.count("*").alias("n"), F.count_if("bare").alias("n_bare"))
    own = per.groupBy("identifier").agg(F.count("*").alias("owners"), *(F.first(c).alias(c) for c in ("supplier_id", "n", "n_bare"))).filter("owners = 1").join(sizes, "supplier_id")
    bare = (F.col("bare_docs") > 0) & (F.col("bare_docs") < F.col("docs")) & (F.col("n_bare") >= F.greatest(F.lit(float(LEAST_BARE)), F.col("bare_docs") * LEAST_SHARE))
    return own.filter((F.col("n") >= F.col("docs") * LEAST_SHARE) | bare).select("supplier_id", "identifier")


def recognised(printed: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, supplier_id, by) of the documents whose ``printed`` (doc_id, identifier) name one supplier of ``known``.

    One that two suppliers have names neither; two suppliers named name no one; web sites alone do not; and a company number
    that nobody has, where none is known, means that the document is another's.
    """
    owners = known.distinct().groupBy("identifier").agg(F.count("*").alias("owners"), F.first("supplier_id").alias("supplier_id"))
    one, company = F.col("owners") == 1, F.col("identifier").startswith("siren:")
    # What nobody or several have says nothing, unless it is a company number.
    rows = printed.distinct().join(owners, "identifier", "left").filter(one | (company & F.col("owners").isNull()))
    per = rows.groupBy("doc_id").agg(
        F.min(F.when(one, F.col("supplier_id"))).alias("supplier_id"), F.max(F.when(one, F.col("supplier_id"))).alias("__most"), F.count_if(one & ~F.col("identifier").startswith("web:")).alias("__firm"),
        F.count_if(one & company).alias("__companies"), F.count_if(company & F.col("owners").isNull()).alias("__strangers"), F.array_join(F.array_sort(F.collect_list(F.when(one, F.col("identifier")))), " ").alias("by"),
    )
    return per.filter((F.col("supplier_id") == F.col("__most")) & (F.col("__firm") > 0) & ((F.col("__strangers") == 0) | (F.col("__companies") > 0))).select("doc_id", "supplier_id", "by")
