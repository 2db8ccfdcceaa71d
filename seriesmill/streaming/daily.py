"""Events to one row per key and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.series import KEY


def daily_totals(
    events: DataFrame, key: str | Column, ts: str = "ts", value: str = "value", delay: str = "1 day"
) -> DataFrame:
    """Daily sums by event time; a day is emitted once the watermark has passed it.

    Later rows of an emitted day are dropped by the watermark.
    """
    source = F.col(key) if isinstance(key, str) else key
    stamped = events.select(
        source.cast("string").alias(KEY),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(value).cast("double").alias("value"),
    ).withWatermark("ts", delay)
    day = F.window("ts", "1 day").alias("day")
    return stamped.groupBy(day, KEY).agg(F.sum("value").alias("y")).select(
        KEY, F.col("day.start").cast("date").alias("ds"), "y"
    )


def daily_table(totals: DataFrame, out: str, progress: str) -> DataFrame:
    """All key-days of ``daily_totals``, those of the last days included, as a table.

    In update mode every micro-batch hands on the new sums of the days it touched.  They are written to a folder named by the
    micro-batch, which a repeated one overwrites, and the newest sum of a key-day counts; nothing waits for the watermark, so
    none is left behind when the stream ends.
    """
    spark = totals.sparkSession
    query = (
        totals.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True)
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    )
    query.awaitTermination()
    newest = spark.read.schema(f"{KEY} string, ds date, y double, batch long").parquet(out)
    return newest.groupBy(KEY, "ds").agg(F.max_by("y", "batch").alias("y"))


def daily_totals_batch(events: DataFrame, key: str | Column, ts: str = "ts", value: str = "value") -> DataFrame:
    source = F.col(key) if isinstance(key, str) else key
    return events.groupBy(source.cast("string").alias(KEY), F.col(ts).cast("date").alias("ds")).agg(
        F.sum(F.col(value).cast("double")).alias("y")
    )
