"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's
id and the child's path, and the smallest draw wins, so a child gets its share of the weights and a change of one child's
weight moves rows only into or out of that child's subtree. A new shard hangs under a region of its own: no other draw
changes, so rows move only into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, text_of_id, text_or_empty

#: Slots are numbered within (shard, chunk) and offset by the chunks before: no task sorts a whole shard. Rows of a chunk, about,
#: and the least and most chunks of a shard; their counts, a row each, are broadcast.
CHUNK_ROWS, CHUNKS, MOST_CHUNKS = 500_000, 256, 8192


@dataclass(frozen=True)
class Tree:
    """``shards[region][rack]`` lists the weights of the shards there; shard numbers follow that order."""

    shards: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, regions: int, racks: int, shards: int) -> Tree:
        return cls((((1.0,) * shards,) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own, numbered after the others."""
        return Tree((*self.shards, ((weight,),)))

    @property
    def count(self) -> int:
        return sum(len(rack) for region in self.shards for rack in region)


def _array(values) -> Column:
    return F.array(*(F.lit(v) if isinstance(v, (int, float)) else _array(v) for v in values))


def _draw(path: Column, weights: Column) -> Column:
    """Index of the child with the smallest draw; children of weight 0 never win, ties go to the first."""

    def cost(path: Column, weight: Column, child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("/", path, child.cast("string"))), 11)
        unit = (bits + 1).cast("double") / F.lit(float(1 << 53))
        return F.struct(F.when(weight > 0, -F.ln(unit) / weight).otherwise(F.lit(float("inf"))).alias("cost"), child.alias("child"))

    return let(path, lambda p: F.array_min(F.transform(weights, lambda w, i: cost(p, w, i))))["child"]


def with_shard(docs: DataFrame, tree: Tree, name: str, id_text: str) -> DataFrame:
    """Add column ``name``: the shard that ``tree`` gives to the text in column ``id_text``. No shuffle."""
    shards = tree.shards
    racks = tuple(tuple(sum(rack) for rack in region) for region in shards)
    first, n = [], 0
    for region in shards:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    region, rack, leaf = f"__{name}_1", f"__{name}_2", f"__{name}_3"
    return (
        docs.withColumn(region, _draw(F.col(id_text), _array([float(sum(r)) for r in racks])))
        .withColumn(rack, _draw(F.concat_ws("/", id_text, region), F.element_at(_array(racks), F.col(region) + 1)))
        .withColumn(leaf, _draw(F.concat_ws("/", id_text, region, rack), F.element_at(F.element_at(_array(shards), F.col(region) + 1), F.col(rack) + 1)))
        .withColumn(name, F.element_at(F.element_at(_array(first), F.col(region) + 1), F.col(rack) + 1) + F.col(leaf))
        .drop(region, rack, leaf)
    )


def shard_documents(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """Place every row of ``docs`` in a shard of ``tree`` (5 regions of 2 racks of 4 shards unless given).

    Returns the id, ``size`` (UTF-8 bytes of the text, null: none, plus 16), ``text_crc32``, ``law`` ('key'), ``shard``,
    ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (the shard in the tree with one more). A null id counts as
    the empty string; rows of one id share a shard; repeated rows get slots of their own; an empty table gives no rows.
    """
    tree = tree or Tree.even(5, 2, 4)
    chunks = chunks or min(MOST_CHUNKS, max(CHUNKS, docs.count() // (tree.count * CHUNK_ROWS)))
    rows = docs.select(
        F.col(id_col),
        text_of_id(id_col).alias("__id"),
        (F.octet_length(text_or_empty(text_col)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(text_col), "UTF-8")).alias("text_crc32"),
    )
    rows = with_shard(with_shard(rows, tree, "shard", "__id"), tree.grown(), "grown_shard", "__id")
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64("__id", "text_crc32"), F.lit(chunks)).cast("int"))
    # At most shards * chunks rows: small whatever the input.
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "__chunk").agg(F.count("*").alias("__n"))
    starts = sizes.select("shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__chunk").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("__at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "__chunk"])
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__at")).cast("long").alias("slot"), "grown_shard")
    )
