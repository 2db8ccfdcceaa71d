"""Intermediate tables in the shared folder, and keys looked up ahead of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.session import scratch_path

# Bits of a membership map, in rows of as many as Spark's bitmap functions hold: 4 MB at most, whatever the table.
_MAP_BITS = 25
_ROW_BITS = 15


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs at most the tasks since the last stage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(number: Column) -> tuple[Column, Column]:
    bit = F.pmod(number, F.lit(1 << _MAP_BITS))
    return F.shiftright(bit, _ROW_BITS), bit.bitwiseAND((1 << _ROW_BITS) - 1)


def split_by_map(df: DataFrame, number: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows whose ``number`` may be among the longs of ``wanted`` (one column), and rows for which it is surely not.

    The map has ``2**25`` bits, dealt over 1024 rows, and is broadcast; with very many wanted numbers it fills up and all rows come
    back in the first part.  Rows with a null number are in the second.
    """
    row, bit = _place(F.col(wanted.columns[0]))
    maps = wanted.select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    at_row, at_bit = _place(number)
    marked = df.withColumn("__row", at_row).withColumn("__bit", at_bit).join(F.broadcast(maps), "__row", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.col("__bit").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    pick = lambda keep: marked.where(keep).select(df.columns)
    return pick(found), pick(~found)
