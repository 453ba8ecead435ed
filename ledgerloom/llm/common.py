"""What the operators share: a shared scratch folder, null-safe text and ASCII folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import shared_dir, written  # noqa: F401
from ledgerloom.sources.ship import ship  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def text_of_id(name: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, even where the optimizer moves expressions into filters: inside ``f`` it is a
    lambda's variable and not a copy of its expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def discard(table: DataFrame) -> None:
    """Remove a table that ``written`` made, once nothing will read it again; what was made from it and written stays."""
    spark = table.sparkSession
    files = table.inputFiles()
    if not files:
        return
    jvm, folder = spark._jvm, files[0].rpartition("/")[0]
    path, shared = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.makeQualified(path.getParent()).toUri().getPath() != fs.makeQualified(shared).toUri().getPath():
        raise ValueError(f"{folder} is not a table of the shared folder")
    fs.delete(path, True)
