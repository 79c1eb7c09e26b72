"""Confusion counts of predictions that arrive as files, by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose keys (id, version, ...) have no output yet; null equals null."""
    d = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & inputs[k].eqNullSafe(F.col(f"_done_{k}"))
    return inputs.join(d, same, "left_anti")


def count_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a query that takes all files there are now (truth, pred among their columns) and ends.

    Each batch writes its own counts to a folder of its number, replacing what a failed attempt left, so a batch that runs
    again counts once. State doesn't grow with the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.select("truth", "pred").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """truth, pred, n of all batches so far."""
    return spark.read.parquet(out).groupBy("truth", "pred").agg(F.sum("n").alias("n"))
