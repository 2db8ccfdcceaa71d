"""Repeated runs of lines, by a suffix array over line ids; later copies are deleted."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.tables import split_by_map, stage


@dataclass(frozen=True)
class Settings:
    """Runs of at least ``min_words`` words count as passages."""

    min_words: int = 50


WORD = r"[^\x20\x09-\x0D]+"
_DOC = ["id", "th"]
_SEG = ["id", "th", "seg"]


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line of every distinct ``(id, text)``: line number, two hashes of the line, its words."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    placed = docs.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return placed.select(
        "id", "th", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("w"),
    )


def _candidates(lines: DataFrame, settings: Settings) -> DataFrame:
    """Lines that occur more than once, in stretches of neighbours with enough words: no other line can be in a repeated run."""
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    met = lines.join(repeated, ["h1", "h2"], "left_semi").dropDuplicates(["id", "th", "i"])
    order = Window.partitionBy(*_DOC).orderBy("i")
    stretched = met.withColumn("seg", F.col("i") - F.row_number().over(order))
    return stretched.withColumn("words", F.sum("w").over(Window.partitionBy(*_SEG))).where(F.col("words") >= settings.min_words).drop("words")


def _ordered(keys: DataFrame, names: list[str]) -> DataFrame:
    """``names, n`` with ``rank``: rows of smaller keys.  Keys are distinct, so a range holds no hot key."""

    def running(batches):
        total = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = np.cumsum(n) + total
            yield batch.append_column("local", pa.array(ends - n))
            total = int(ends[-1]) if len(n) else total

    parted = keys.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{c} {t}" for c, t in parted.dtypes)
    summed = stage(parted.mapInArrow(running, f"{fields}, local long"), "ranks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = summed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return summed.join(F.broadcast(before), "part").select(*names, "n", (F.col("local") + F.col("before")).alias("rank"))


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Rank tables of prefix doubling over ``id, th, seg, i, h1, h2``: table ``k`` orders suffixes by ``2**k`` lines.

    A rank is the number of suffixes before the bucket of equal prefixes, so each table is the suffix array in
    bucket order at its depth; suffixes end with their stretch.  Doubling stops at the last power of two within
    ``longest`` (with the lines of the longest stretch it gives the whole array).  A round sorts the distinct rank pairs only
    and joins the rank back.  Suffixes whose bucket is theirs alone keep their rank and are not ranked again.
    """
    first = _ordered(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")), ["h1", "h2"])
    tables = [stage(lines.join(first, ["h1", "h2"]).select(*_SEG, "i", F.col("rank").alias("r"), (F.col("n") > 1).alias("open")), "suffixes")]
    depth = 1
    while 2 * depth <= longest:
        paired = tables[-1].withColumn("r2", F.coalesce(
            F.lead("r", depth).over(Window.partitionBy(*_SEG).orderBy("i")), F.lit(-1)))
        paired = stage(paired, "pairs")
        buckets = paired.where("open").groupBy("r", "r2").agg(F.count("*").alias("n"))
        if buckets.isEmpty():
            break
        # Inside a bucket the pairs come in order; its first rank is the bucket's own.
        ranked = _ordered(buckets, ["r", "r2"])
        least = ranked.groupBy("r").agg(F.min("rank").alias("least"))
        moved = ranked.join(least, "r").select("r", "r2", (F.col("r") + F.col("rank") - F.col("least")).alias("to"), (F.col("n") > 1).alias("still"))
        opened = paired.where("open").join(moved, ["r", "r2"]).select(*_SEG, "i", F.col("to").alias("r"), F.col("still").alias("open"))
        tables.append(stage(opened.union(paired.where("NOT open").select(*_SEG, "i", "r", "open")), "suffixes"))
        depth *= 2
    return tables


def _runs(lines: DataFrame, settings: Settings) -> DataFrame:
    """``id, th, seg, i, len``: the shortest run of enough words from each line on, and up to each line.

    A repeated run with enough words is covered by those of its own lines, so these runs decide for all longer ones.
    """
    forward = Window.partitionBy(*_SEG).orderBy("i")
    summed = lines.withColumn("c", F.sum("w").over(forward))

    def cut(batches):
        for batch in batches:
            parts = []
            for k in range(batch.num_rows):
                i = batch.column("at")[k].values.to_numpy()
                c = batch.column("sums")[k].values.to_numpy()
                before = np.concatenate([[0], c[:-1]])
                last = np.searchsorted(c, before + settings.min_words)  # first line that fills the run
                ok = last < len(c)
                first = np.searchsorted(before, c - settings.min_words, "right") - 1
                full = c >= settings.min_words
                starts = np.concatenate([i[ok], i[first[full]]])
                sizes = np.concatenate([last[ok] - np.flatnonzero(ok) + 1, np.flatnonzero(full) - first[full] + 1])
                found = np.unique(np.stack([starts, sizes], axis=1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
                parts.append((k, found))
            owner = np.repeat([k for k, _ in parts], [len(f) for _, f in parts]).astype(np.int64)
            table = np.concatenate([f for _, f in parts]) if parts else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(owner)) for c in _SEG] + [pa.array(table[:, 0].astype(np.int32)), pa.array(table[:, 1].astype(np.int32))],
                [*_SEG, "i", "len"])

    rows = F.sort_array(F.collect_list(F.struct("i", "c")))
    arrays = summed.groupBy(*_SEG).agg(rows.alias("x")).select(*_SEG, F.col("x.i").alias("at"), F.col("x.c").alias("sums"))
    kinds = dict(lines.dtypes)
    return arrays.mapInArrow(cut, ", ".join(f"{c} {kinds[c]}" for c in _SEG) + ", i int, len int")


def repeated_runs(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later copies of repeated line runs: ``id, th, i, len`` (first line and lines of a run; ``th`` hashes the text).

    Suffixes with a common prefix of ``len`` lines are an interval of the suffix array.  With the rank tables it is named by
    ``len`` and the ranks of the two blocks of ``2**k`` lines, ``k`` the largest that fits, that begin and end the prefix.
    The interval's first member in order of (id, text hash, line) is the original, the others are copies.
    """
    lines = stage(_lines(df, id_col, text_col), "lines")
    kept = stage(_candidates(stage(_candidates(lines, settings), "candidates").drop("seg"), settings), "candidates")
    runs = stage(_runs(kept, settings), "runs")
    longest = runs.agg(F.max("len")).first()[0] or 0
    tables = suffix_ranks(kept, longest)
    level = F.least(F.expr("length(bin(len)) - 1"), F.lit(len(tables) - 1))
    placed = runs.withColumn("level", level).withColumn("j", F.expr("i + len - shiftleft(1, level)"))
    ranks = None
    for k, table in enumerate(tables):
        part = table.select(*_SEG, F.lit(k).alias("level"), "i", "r")
        ranks = part if ranks is None else ranks.union(part)
    named = placed.join(ranks, [*_SEG, "level", "i"]).withColumnRenamed("r", "head").join(
        ranks.select(*_SEG, "level", F.col("i").alias("j"), F.col("r").alias("tail")), [*_SEG, "level", "j"])
    interval = ["len", "head", "tail"]
    first = named.groupBy(*interval).agg(F.min(F.struct("id", "th", "i")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = named.join(first, interval).where(F.struct("id", "th", "i") != F.col("first"))
    return copies.select("id", "th", "i", "len")


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines numbered in ``gone``."""
    lines = F.split(text, "\n")
    return F.transform(F.array(lines), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: x[i]), "\n"))[0]


def dedup_lines(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later copies of repeated runs cut from the text, and the column ``lines_deleted`` (long).

    The first copy in order of id (nulls first), hash of the text and line stays.  Rows that agree in id and text are one
    document: they get the same answer.  Null stays null, a text all of whose lines are copies becomes empty.  A
    column ``lines_deleted`` of ``df`` is replaced; all others stay.
    """
    copies = repeated_runs(df, settings, id_col, text_col)
    gone = copies.select("id", "th", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("len") - 1)).alias("line")).groupBy("id", "th").agg(
        F.collect_set("line").alias("__gone"))
    gone = stage(gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__gone"), "gone")
    gone_ids = gone.select("__th")
    docs = df.drop("lines_deleted")
    # Texts without a copy stay where they are; only those that may have one are joined.
    may, untouched = split_by_map(docs, F.xxhash64(text_col), gone_ids)
    joined = may.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    deleted = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col("__gone")))
    cut = joined.withColumn(text_col, text).withColumn("lines_deleted", deleted).drop("__id", "__th", "__gone")
    return cut.unionByName(untouched.withColumn("lines_deleted", F.lit(0).cast("long")))
