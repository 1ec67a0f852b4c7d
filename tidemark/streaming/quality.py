"""The same plan serves batch and stream: measures per window of event time, late rows bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import col, finite, missing


def quality_by_window(df: DataFrame, time: str, column: str, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """start, n, missing, mean of a column per tumbling window."""
    rows = df.withColumn(time, col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    made = rows.groupBy(F.window(col(time), window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(missing(rows, column)).alias("missing"), F.avg(finite(rows, column)).alias("mean"))
    return made.select(F.col("w.start").alias("start"), "n", "missing", "mean")


def quality_by_day(df: DataFrame, time: str = "ts", column: str = "value") -> DataFrame:
    return quality_by_window(df, time, column).withColumnRenamed("start", "day")


def each_batch(df: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a report of every micro-batch to ``path``, partitioned by batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
