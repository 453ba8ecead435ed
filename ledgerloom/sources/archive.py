"""Archives: tables as JSON sections beside a manifest of their rows and digests; an import refuses what does not agree."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one part of a section, about: what one digest covers, and one task reads for it.
PART_ROWS = 50_000
PARTS = "section string, part int, n long, digest string"


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def digests(df: DataFrame, parts: int, keys: Iterable[str] = ()) -> DataFrame:
    """(part, n, digest): the SHA-256 of each part's rows, whatever their order; a part is a hash of ``keys`` (the first column
    unless named), so that a row that was changed stays in its part."""
    of = [F.col(f"`{c}`").cast("string") for c in (list(keys) or df.columns[:1])]
    rows = df.select(F.pmod(F.xxhash64(*of), F.lit(parts)).cast("int").alias("part"), F.sha2(_row(df), 256).alias("row"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ""), 256).alias("digest"))


def root(parts: DataFrame) -> str:
    """The digest over the digests of all parts."""
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("part").cast("string"), 12, "0"), F.col("n").cast("string"), "digest"))), ",")
    return parts.agg(F.sha2(listed, 256)).first()[0]


def dump(tables: dict[str, DataFrame], path: str, keys: Mapping[str, Iterable[str]] | None = None) -> None:
    """Write each table as a section, then the digests of its parts, then the manifest: an archive without one is not whole.
    ``keys``: columns that tell a section's rows apart. Empty tables are sections without parts."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/{name}")
        n, of = df.count(), list((keys or {}).get(name, df.columns[:1]))
        parts = n // PART_ROWS + 1
        # Digests are of what was written.
        found = digests(spark.read.schema(df.schema).json(f"{path}/{name}"), parts, of).withColumn("section", F.lit(name))
        found.write.mode("overwrite").json(f"{path}/digests/{name}")
        rows.append((name, n, parts, of, root(spark.read.schema(PARTS).json(f"{path}/digests/{name}")), df.schema.json()))
    spark.createDataFrame(rows, "section string, n long, parts int, keys array<string>, root string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every section, read with its schema, after its parts have been checked; what does not agree is named: the digests with
    the manifest, or a section's parts with the digests."""
    from pyspark.sql.types import StructType

    out = {}
    manifest = spark.read.schema("section string, n long, parts int, keys array<string>, root string, schema string").json(f"{path}/manifest")
    for r in manifest.collect():
        df = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).json(f"{path}/{r['section']}")
        stored = spark.read.schema(PARTS).json(f"{path}/digests/{r['section']}")
        if root(stored) != r["root"]:
            raise ValueError(f"the digests of section {r['section']} do not agree with the manifest")
        now = digests(df, r["parts"], r["keys"]).select("part", F.struct("n", "digest").alias("now"))
        wrong = stored.select("part", F.struct("n", "digest").alias("then")).join(now, "part", "full").filter(~F.col("now").eqNullSafe(F.col("then"))).orderBy("part").limit(10).collect()
        if wrong:
            raise ValueError(f"section {r['section']}: parts {[x.part for x in wrong]} of {r['parts']} do not agree with their digests")
        out[r["section"]] = df
    return out


# ---- keys that survive another database ------------------------------------------------------------------------------


def with_key(df: DataFrame, columns: Iterable[str], order: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``key`` (its natural columns as JSON) and ``rank``: which of several rows of that key it is, by ``order``; null
    where there are several and no order tells them apart."""
    of = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})
    rows = df.withColumn("key", of)
    by = [F.col(f"`{c}`") for c in order]
    alone = F.count("*").over(Window.partitionBy("key")) == 1
    if not by:
        return rows.withColumn("rank", F.when(alone, 1))
    same = F.count("*").over(Window.partitionBy("key", *by)) > 1
    return rows.withColumn("rank", F.when(~same, F.row_number().over(Window.partitionBy("key").orderBy(*by))))


def resolve(references: DataFrame, here: DataFrame, id_col: str) -> DataFrame:
    """``references`` (key, rank, ...) with the id of the row of ``here`` (``with_key``) that each means, and ``refused``: why none is
    (``missing``, or ``ambiguous`` where several rows are alike on either side)."""
    known = here.groupBy("key", "rank").agg(F.min(id_col).alias(id_col))
    any_ = here.groupBy("key").agg(F.max(F.col("rank").isNull()).alias("__alike"))
    rows = references.join(known.filter("rank is not null"), ["key", "rank"], "left").join(any_, "key", "left")
    unclear = F.col("rank").isNull() & F.col("__alike").isNotNull() | F.coalesce("__alike", F.lit(False)) & F.col(id_col).isNull()
    return rows.withColumn("refused", F.when(unclear, "ambiguous").when(F.col(id_col).isNull(), "missing")).drop("__alike")


def closure(wanted: Iterable[str], needs: Mapping[str, Iterable[str]]) -> list[str]:
    """The wanted sections and all that they need, each behind what it needs, else by name. A circle or an unknown one raises."""
    out: list[str] = []
    open_: list[str] = []

    def add(name: str) -> None:
        if name in out:
            return
        if name in open_ or name not in needs:
            raise ValueError(f"sections in a circle: {[*open_, name]}" if name in open_ else f"no section {name}")
        open_.append(name)
        for other in sorted(needs[name]):
            add(other)
        open_.pop()
        out.append(name)

    for name in sorted(wanted):
        add(name)
    return out
