"""Days in order: rows wait until the watermark has passed them, later ones go to a table of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.operators.series import KEY
from seriesmill.session import scratch_path


@dataclass(frozen=True)
class Ordered:
    """Paths of one ordered stream: released rows, late rows, and what still waits, each with a folder per micro-batch."""

    released: str
    late: str
    waiting: str
    marks: str

    @classmethod
    def below(cls, root: str) -> Ordered:
        return cls(*(f"{root}/{name}" for name in ("released", "late", "waiting", "marks")))


def _read(spark: SparkSession, path: str, batch: int, schema) -> DataFrame:
    """What a micro-batch left, or nothing before the first."""
    return spark.createDataFrame([], schema) if batch < 0 else spark.read.schema(schema).parquet(f"{path}/batch={batch}")


def release_in_order(stream: DataFrame, paths: Ordered, delay_days: int = 1, progress: str | None = None) -> Ordered:
    """Sort a stream ``series_key, ds, ...`` of days that arrive late, with the watermark ``newest day - delay_days``.

    After each micro-batch the rows of all days up to the watermark are released; rows of days that were released before go to
    ``late``.  So a key's days are released in order over all micro-batches, and what waits is bounded by the days of the
    delay.  Each folder is named by its micro-batch and overwritten when that is repeated, so a restart changes nothing.
    """
    spark, schema = stream.sparkSession, stream.schema
    marks = "day date"

    def step(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        before = batch - 1
        mark = _read(session, paths.marks, before, marks).first() if before >= 0 else None
        passed = F.lit(mark["day"] if mark else None).cast("date")
        late = F.coalesce(F.col("ds") <= passed, F.lit(False))
        rows.where(late).write.mode("overwrite").parquet(f"{paths.late}/batch={batch}")
        rows.where(~late).unionByName(_read(session, paths.waiting, before, schema)).write.mode("overwrite").parquet(f"{paths.marks}-held/batch={batch}")
        held = session.read.schema(schema).parquet(f"{paths.marks}-held/batch={batch}")
        newest = held.agg(F.max("ds")).first()[0]
        reached = F.greatest(F.date_sub(F.lit(newest).cast("date"), delay_days), passed)
        session.range(1).select(reached.alias("day")).write.mode("overwrite").parquet(f"{paths.marks}/batch={batch}")
        # One file holds all days of a key in a release, so a reader that takes files one by one meets them in order.
        ready = F.coalesce(F.col("ds") <= reached, F.lit(False))
        held.where(ready).repartition(KEY).sortWithinPartitions(KEY, "ds").write.mode("overwrite").parquet(f"{paths.released}/batch={batch}")
        held.where(~ready).write.mode("overwrite").parquet(f"{paths.waiting}/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", progress or scratch_path(spark, "ordered-progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return paths


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def ordered_rows(spark: SparkSession, paths: Ordered, schema, flush: bool = True) -> DataFrame:
    """All released rows; with ``flush`` also those that still waited when the stream ended."""
    rows = _batches(spark, paths.released, schema)
    if not flush:
        return rows
    # The newest folder of what waits, by its number.
    last = spark.read.option("basePath", paths.marks).parquet(paths.marks).agg(F.max("batch")).first()[0]
    return rows if last is None else rows.unionByName(_read(spark, paths.waiting, last, schema))


def late_rows(spark: SparkSession, paths: Ordered, schema) -> DataFrame:
    return _batches(spark, paths.late, schema)
