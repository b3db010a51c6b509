"""Incremental runs of the batch operators: new files only, with checkpoints, until all that is there has been read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream over the files of a folder; a restarted query goes on where its checkpoint ends."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def drain(rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write what ``transform`` makes of every micro-batch to ``out``, once each, and stop when nothing is left."""
    made = transform(rows) if transform else rows
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def count_tokens(rows: DataFrame, tokens: str, name: str, checkpoint: str) -> StreamingQuery:
    """A running (token, freq) table in memory under ``name``: the vocabulary's partial sums."""
    freq = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return freq.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def first_of_each(rows: DataFrame, text: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose text hasn't come before; with a time column state is kept for ``delay`` only."""
    keyed = rows.withColumn("_hash", F.sha2(F.col(text), 256))
    if time is None:
        return keyed.dropDuplicates(["_hash"]).drop("_hash")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def windowed_counts(rows: DataFrame, time: str, keys: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window, late rows within ``delay`` among them (an extension of the engine's own)."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
