"""The till as a stream: days with a shifted boundary, and lines that arrive twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.sources.scratch import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int | None = None, pattern: str = "events.parquet", like: str | None = None) -> DataFrame:
    """The events table as a stream of files; ``like`` is a file or table with its schema, where that is not ``events``."""
    schema = spark.read.parquet(like or f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (rows.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else rows).parquet(sf_dir)


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder; restarting from its checkpoint is exact.

    Without ``keys`` batches append. An aggregate has its group's ``keys``: batches hold the groups that changed, and the table
    has each as its last batch left it, so however many batches there were each line counts once, and state ends at the
    watermark.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # One folder a batch, overwritten if the batch runs again: exactly once.
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("__batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    if keys:
        others = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__last")).select(*keys, "__last.*")
    return out.select(*stream.columns)


def business_days(stream: DataFrame, hours: int = 6, late: str = "3 days") -> DataFrame:
    """Counts and sums by business day and kind: tumbling days that begin at ``hours``; lines up to ``late`` still count."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(12,2)").alias("value")).withWatermark("ts", late)
    days = F.window("ts", "1 day", "1 day", f"{hours} hours")
    return rows.groupBy(days.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def once(stream: DataFrame, keys: list[str], late: str = "3 days") -> DataFrame:
    """Each line once, however often it arrives within ``late``."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
