"""Structured Streaming forms of the batch operators: annotate files as they come, count events by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hemiciclo.functions import rules as R


def annotated_stream(spark: SparkSession, folder: str, schema: StructType, key: str, text: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the parquet files of a folder with the rule columns of their text. No state, so no watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return R.annotated(rows.select(key, text), text).select(key, F.col("topic.axis").alias("axis"), "instrument", "quant", "horizon", "score")


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Count and sum of value for each window and kind; rows later than `late` behind the newest are dropped by the watermark."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n", F.round("total", 4).alias("total"))


def first_deliveries(rows: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key once, as it comes first; state is dropped when the watermark passes."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop. checkpoint lies in the shared folder of the cluster."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
