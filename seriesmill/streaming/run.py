"""Run a stream over everything available and hand back its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmill.session import scratch_path


def file_stream(spark: SparkSession, path: str, like: DataFrame, pattern: str | None = None, per_trigger: int | None = None):
    """Parquet files below ``path`` as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input in append mode into a Parquet table and read it.

    Output and progress go to the shared folder, so a restarted run with the same
    two paths continues where the last one stopped.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
