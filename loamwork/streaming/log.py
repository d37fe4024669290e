"""Resumable scoring logs, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(batches: DataFrame, log: DataFrame, digest: str = "batch_digest", keep: str = "status = 'ok'") -> DataFrame:
    """Batches without a complete success in the log."""
    return batches.join(log.where(keep).select(digest).distinct(), digest, "left_anti")


def latest(log: DataFrame, digest: str = "batch_digest", order: str = "ts") -> DataFrame:
    """The last entry of each batch."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(digest).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def scored(batches: DataFrame, score: Callable, schema: str) -> DataFrame:
    """``batches`` through an injected scorer of pandas frames; the caller's function talks to whatever it needs."""
    return batches.mapInPandas(score, schema)


def deduplicated(stream: DataFrame, digest: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First entry of each digest within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([digest])


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Count and mean by time window and key; late rows within the delay still count."""
    w = F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(w, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def upsert_sink(path: str, digest: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch's last entries go to a folder of their own, so a batch run again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, digest, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str, digest: str = "batch_digest", order: str = "ts") -> StreamingQuery:
    """Runs the stream to its present end into the folder."""
    writer = stream.writeStream.foreachBatch(upsert_sink(path, digest, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()
