"""Best-fit decreasing packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import tokens as T
from seriesmill.llm import words as W
from seriesmill.llm.tables import stage


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096
    tokenizer: str | None = None  # path; the default file if not given


class CapacityTree:
    """Segment tree over remaining capacities; a leaf counts the open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += bins
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` among open bins, in logarithmic time."""
        at = length + self.size
        if self.counts[at]:
            return length
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at *= 2
            if not self.counts[at]:
                at += 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over ``{length: pieces}``; rows ``length, rank, pieces, per_bin, bin, offset``.

    Pieces of one length are alike, so bins with equal room are filled together: pieces ``rank`` up to
    ``rank + pieces`` of a length go to bins from ``bin`` on, ``per_bin`` into each from ``offset`` on.  The bins are those
    that best-fit decreasing opens piece by piece.  Input and result are bounded by the capacity, not by the number of pieces.
    """
    tree, open_bins = CapacityTree(capacity), defaultdict(list)  # room -> [(first bin, bins)]
    rows, next_bin = [], 0

    def opened(room: int, first: int, bins: int) -> None:
        if bins and room:
            open_bins[room].append((first, bins))
            tree.add(room, bins)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # New bins take as many pieces of this length as fit.
                room, per = capacity, capacity // length
                first, bins = next_bin, max(1, left // per)
                next_bin += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
                per = room // length
            whole = min(bins, left // per)
            if whole:
                rows.append((length, rank, whole * per, per, first, capacity - room))
                rank, left = rank + whole * per, left - whole * per
                opened(room - per * length, first, whole)
            if whole < bins:
                part = left if left < per else 0  # the last pieces fill a bin in part
                if part:
                    rows.append((length, rank, part, part, first + whole, capacity - room))
                    rank, left = rank + part, 0
                    opened(room - part * length, first + whole, 1)
                opened(room, first + whole + bool(part), bins - whole - bool(part))
    return np.array(rows, np.int64).reshape(-1, 6)


_PIECES = "piece int, start long, length long, ids_crc32 long, task int, nth long"


def _cut(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.encoder(settings.tokenizer or T.default_tokenizer())
        task, seen = TaskContext.get().partitionId(), np.zeros(settings.capacity + 1, np.int64)
        for batch in batches:
            for begin, texts in W.blocks(batch.column("text"), W.BLOCK_BYTES // 4):
                ids, starts = encoder.encode(texts)
                whole = np.diff(starts)
                pieces = -(-whole // settings.capacity)
                owner = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * settings.capacity
                length = np.minimum(settings.capacity, whole[owner] - start)
                first, raw = starts[owner] + start, ids.astype("<u4")
                # The place of a piece among those of its length in this task.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered)
                nth += seen[length]
                seen += np.bincount(length, minlength=settings.capacity + 1)
                crc = [zlib.crc32(raw[a : a + n].data) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(begin, len(texts)).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), task, np.int32)), pa.array(nth),
                ], ["id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def pack(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens and their places: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only texts longer than the capacity are cut.  A null or empty text is its end id alone; repeated rows are
    packed each.  Token counts are written once; what reaches the driver is the histogram of lengths (at most
    ``capacity`` rows) and what returns to the tasks is the plan made from it.  A piece's rank among those of its length is
    its place within its task plus the pieces of earlier tasks, so no length is gathered in one place.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["id"]
    pieces = stage(docs.mapInArrow(W.lean(_cut(settings)), f"id {kind}, {_PIECES}"), "pieces")
    counts = stage(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, settings.capacity)
    shared = df.sparkSession.sparkContext.broadcast(rows)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before.hint("merge"), ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        order = np.argsort(keys)
        table, keys = table[order], keys[order]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(row[:, 4] + at // row[:, 3]), pa.array(row[:, 5] + at % row[:, 3] * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
