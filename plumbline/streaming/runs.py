"""Judge calls as a stream: running accuracy by event-time window, and first-seen calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 days"


def windowed_accuracy(calls: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Calls, answers and accuracy by window of ``ts``; state is dropped behind the watermark."""
    w = F.window("ts", width)
    return calls.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_calls"), F.count("pred").alias("n_answered"), F.avg(F.col("ok").cast("double")).alias("accuracy")).select(F.col("w.start").alias("start"), "n_calls", "n_answered", F.round("accuracy", 6).alias("accuracy"))


def first_seen(calls: DataFrame, late: str = LATE) -> DataFrame:
    """Repeated deliveries of a call within the watermark are dropped."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file", "call_idx"])


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything that is there now, as a batch frame; for results of a bounded number of windows."""
    spark: SparkSession = stream.sparkSession
    name = f"plumbline_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append-mode Parquet sink with its own checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
