"""Search progress as a stream: runs arrive in batches, states live in a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from ledgerloom.operators import progress


def _states(spark: SparkSession, folder: str, source: StructField, before: int) -> DataFrame:
    """Each source's state after the batches before ``before``."""
    schema = StructType([source, *(StructField(c, DateType()) for c in ("searched_until", "hole_from", "hole_until")), StructField("batch", LongType())])
    rows = spark.read.schema(schema).parquet(folder).filter(F.col("batch") < before)
    newest = F.max_by(F.struct("searched_until", "hole_from", "hole_until"), "batch").alias("x")
    return rows.groupBy("source").agg(newest).select("source", "x.*")


def advance(runs: DataFrame, folder: str) -> None:
    """Fold a stream of runs (``progress.steps``) into ``folder``: ``states/batch=n`` with the sources that changed and
    ``steps/batch=n`` with what each run did.

    A batch reads the states of those before it and overwrites its own folders, so one that runs again after a crash says
    the same; the checkpoint beside them goes on where it stopped."""
    spark = runs.sparkSession
    source = runs.schema["source"]
    # The folder is a table before its first batch.
    spark.createDataFrame([], StructType([source, *(StructField(c, DateType()) for c in ("searched_until", "hole_from", "hole_until"))])).write.mode("overwrite").parquet(f"{folder}/states/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        done = progress.steps(batch, _states(spark, f"{folder}/states", source, number))
        done.write.mode("overwrite").parquet(f"{folder}/steps/batch={number}")
        progress.last(spark.read.parquet(f"{folder}/steps/batch={number}")).write.mode("overwrite").parquet(f"{folder}/states/batch={number}")
        batch.unpersist()

    runs.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
