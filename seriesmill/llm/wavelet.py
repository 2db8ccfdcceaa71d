"""Token ids as one compressed wavelet matrix per shard: access, rank, select and occurrences from a single file."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.llm import tokens as T
from seriesmill.llm import words as W
from seriesmill.llm.tables import stage
from seriesmill.session import scratch_path

# File: magic, length of the JSON head, head, the table of part sizes, the rank directory, then the compressed parts: the pieces of each
# bit-plane, the ends of the documents, and their names.
MAGIC = b"SMWM0002"
SUFFIX = ".wm"
_PIECE = 1 << 14  # bytes of a plane that are compressed together


@dataclass(frozen=True)
class Settings:
    """A shard ends with the document that brings it to ``shard_tokens``, so it holds at most one document more."""

    tokenizer: str | None = None
    shard_tokens: int = 2_000_000
    partitions: int | None = None
    level: int = 1


def build(ids: np.ndarray, ends: np.ndarray, names: pa.Array, base: int = 0, task: int = 0, level: int = 1) -> bytes:
    """File content for ``ids`` of the documents ``names``, which end at ``ends``; ``base`` ids of task ``task`` stand before them.

    The directory holds the ones of each plane before each of its pieces, so a query inflates one piece of a plane.
    """
    bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    order, zeros, parts, directory = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
    for shift in range(bits - 1, -1, -1):
        flags = (order & order.dtype.type(1 << shift)) != 0
        low = order.compress(~flags)  # a mask as index takes several times as long
        zeros.append(len(low))
        plane = np.packbits(flags)
        pieces = [plane[k : k + _PIECE] for k in range(0, len(plane), _PIECE)]
        directory.append(np.cumsum([0, *(int(np.bitwise_count(p).sum()) for p in pieces)])[:-1])
        parts += [p.tobytes() for p in pieces]
        order = np.concatenate([low, order.compress(flags)])  # zeros first, each side in its old order
    parts.append(ends.astype("<i8").tobytes())
    table = pa.RecordBatch.from_arrays([names], ["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    parts.append(sink.getvalue().to_pybytes())
    press = zstandard.ZstdCompressor(level)
    packed = [press.compress(p) for p in parts]
    tables = [np.array([len(p) for p in packed], "<i4").tobytes(), np.concatenate(directory).astype("<i8").tobytes()]
    head = json.dumps({"n": len(ids), "documents": len(ends), "base": base, "task": task, "bits": bits, "zeros": zeros, "parts": len(packed)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *tables, *packed])


class Shard:
    """Reader of one file; a piece of a plane is inflated when a query first meets it.

    Queries take one place (or token, or rank) or an array of them, and answer in kind.
    """

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", content, len(MAGIC))
        start = len(MAGIC) + 4
        self.head = json.loads(content[start : start + size])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        start += size
        sizes = np.frombuffer(content, "<i4", self.head["parts"], start)
        start += sizes.nbytes
        self.pieces = (self.head["parts"] - 2) // self.bits
        self.directory = np.frombuffer(content, "<i8", self.bits * self.pieces, start).reshape(self.bits, self.pieces)
        start += self.directory.nbytes
        self._content, self._starts = content, np.cumsum([start, *sizes])
        self._inflate = zstandard.ZstdDecompressor()
        self._pieces: dict[tuple[int, int], np.ndarray] = {}
        self._ranks: dict[tuple[int, int], np.ndarray] = {}
        self._padded: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, k: int) -> bytes:
        return self._inflate.decompress(self._content[self._starts[k] : self._starts[k + 1]])

    @cached_property
    def ends(self) -> np.ndarray:
        return np.frombuffer(self._part(self.head["parts"] - 2), "<i8")

    @cached_property
    def names(self) -> pa.Array:
        """The ids of the documents."""
        with pa.ipc.open_stream(self._part(self.head["parts"] - 1)) as stream:
            return pa.concat_arrays([batch.column("id") for batch in stream])

    def piece(self, level: int, k: int) -> np.ndarray:
        """The bytes of one piece of a plane."""
        if (level, k) not in self._pieces:
            self._pieces[level, k] = np.frombuffer(self._part(level * self.pieces + k), np.uint8)
        return self._pieces[level, k]

    def _ones_before(self, level: int, k: int) -> np.ndarray:
        """Ones of the plane before each byte of a piece."""
        if (level, k) not in self._ranks:
            self._padded[level, k] = np.append(self.piece(level, k), np.uint8(0))
            counts = np.bitwise_count(self.piece(level, k))
            self._ranks[level, k] = self.directory[level, k] + np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return self._ranks[level, k]

    def _by_piece(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones of a plane before each place, and the bit there (0 behind the end)."""
        ones, bit = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        which = np.minimum(at >> 3, max((self.n + 7) // 8 - 1, 0)) // _PIECE
        order = np.argsort(which, kind="stable")
        met, starts = np.unique(which[order], return_index=True)
        for k, rows in zip(met.tolist(), np.split(order, starts[1:])) if self.pieces else ():
            place = at[rows] - (k * _PIECE << 3)
            before = self._ones_before(level, k)
            byte = self._padded[level, k][place >> 3].astype(np.int64)
            ones[rows] = before[place >> 3] + np.bitwise_count(byte >> (8 - (place & 7)))
            bit[rows] = byte >> (7 - (place & 7)) & 1
        return ones, bit

    def access(self, at):
        """The token at a place."""
        place = np.atleast_1d(np.asarray(at, np.int64))
        value = np.zeros(len(place), np.int64)
        for level in range(self.bits):
            ones, bit = self._by_piece(level, place)
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
            value = value << 1 | bit
        return value if np.ndim(at) else int(value[0])

    def _start(self, token: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places of ``token`` from ``at`` on begin below the last plane."""
        for level in range(self.bits):
            ones, _ = self._by_piece(level, at)
            at = np.where(token >> (self.bits - 1 - level) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def count(self, token, low=0, high=None):
        """Occurrences of a token in places ``low`` to ``high`` (the end)."""
        tokens, lows, highs = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, np.int64)) for x in (token, low, self.n if high is None else high)))
        inside = (tokens >= 0) & (tokens < 1 << self.bits)
        found = np.where(inside, self._start(tokens, highs) - self._start(tokens, lows), 0)
        return found if np.ndim(token) or np.ndim(low) or np.ndim(high) else int(found[0])

    def _select_bit(self, level: int, bit: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the ``k``-th bit of a kind: its piece by the directory, its byte by the ranks there, its place in the byte."""
        out, first = np.zeros(len(k), np.int64), np.arange(self.pieces) * (_PIECE << 3)
        for kind in (0, 1):
            rows = np.flatnonzero(bit == kind)
            ahead = self.directory[level] if kind else first - self.directory[level]
            which = np.searchsorted(ahead, k[rows], "right") - 1
            for piece in np.unique(which).tolist():
                at = rows[which == piece]
                before = self._ones_before(level, piece)
                if not kind:
                    before = first[piece] + 8 * np.arange(len(before)) - before
                byte = np.searchsorted(before, k[at], "right") - 1
                flags = np.unpackbits(self._padded[level, piece][byte][:, None], axis=1) == kind
                inside = (np.cumsum(flags, axis=1) > (k[at] - before[byte])[:, None]).argmax(axis=1)
                out[at] = first[piece] + 8 * byte + inside
        return out

    def select(self, token, k):
        """Place of the ``k``-th occurrence (from 0)."""
        tokens, ranks = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, np.int64)) for x in (token, k)))
        if np.any((ranks < 0) | (ranks >= self.count(tokens))):
            raise IndexError(k)
        at = self._start(tokens, np.zeros(len(tokens), np.int64)) + ranks
        for level in range(self.bits - 1, -1, -1):
            bit = tokens >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, np.where(bit == 1, at - self.zeros[level], at))
        return at if np.ndim(token) or np.ndim(k) else int(at[0])

    def occurrences(self, token: int) -> list[int]:
        return self.select(token, np.arange(self.count(token))).tolist()

    def decode(self) -> np.ndarray:
        """All tokens, rebuilt from the last plane upwards."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self.piece(level, k) for k in range(self.pieces)]) if self.pieces else np.zeros(0, np.uint8)
            flags = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~flags)] = values[: self.zeros[level]]
            above[np.flatnonzero(flags)] = values[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            values = above
        return values.astype(np.uint32)

    def documents(self) -> Iterator[np.ndarray]:
        ids, start = self.decode(), 0
        for end in self.ends:
            yield ids[start:end]
            start = end


def write_shards(df: DataFrame, folder: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts in ascending order of id and write them as shard files below ``folder`` (shared by all executors).

    Returns one row per file: ``task, number, base, n_tokens``.  A task writes the files of its range of ids; a file is written under another name and
    moved, and a repeated task writes the same files again.  Null ids come first, equal ids in the order of a hash
    of their text; a null text is empty.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = ["id", F.xxhash64("text")]
    dealt = docs.repartitionByRange(settings.partitions, *keys) if settings.partitions else docs.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.encoder(settings.tokenizer or T.default_tokenizer())
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        base, number, ids, lengths, names = 0, 0, [], [], []

        def flush():
            nonlocal base, number
            tokens = np.concatenate(ids)
            content = build(tokens, np.cumsum(np.concatenate(lengths)), pa.concat_arrays(names), base, task, settings.level)
            name = f"{root}/{task:06d}-{number:06d}"
            with files.open_output_stream(f"{name}.{attempt}.part") as out:
                out.write(content)
            files.move(f"{name}.{attempt}.part", name + SUFFIX)
            row = pa.RecordBatch.from_arrays([
                pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([base], pa.int64()), pa.array([len(tokens)], pa.int64()),
            ], ["task", "number", "base", "n_tokens"])
            base, number = base + len(tokens), number + 1
            ids.clear(), lengths.clear(), names.clear()
            return row

        held = 0
        for batch in batches:
            for begin, texts in W.blocks(batch.column("text"), W.BLOCK_BYTES // 2):
                found, starts = encoder.encode(texts)
                ids.append(found)
                lengths.append(np.diff(starts))
                names.append(batch.column("id").slice(begin, len(texts)))
                held += len(found)
                if held >= settings.shard_tokens:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return ordered.mapInArrow(W.lean(write), "task int, number int, base long, n_tokens long")


def read_shards(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    """One row per document in the files: ``id, task, start, n_tokens, ids_crc32, last_id, n_end_ids, last_end``.

    ``start`` counts from the task's first id.  The last id is looked up by access, the end ids of the document are
    counted by rank, and the place of the last one (from the document's start) is found by select.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                shard = Shard(content.as_py())
                crc = [zlib.crc32(ids.astype("<u4").data) for ids in shard.documents()]
                starts = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                until = shard.count(T.END_ID, np.zeros(len(starts), np.int64), shard.ends)
                own = shard.count(T.END_ID, starts, shard.ends)
                yield pa.RecordBatch.from_arrays([
                    shard.names, pa.array(np.full(len(crc), shard.head["task"], np.int32)), pa.array(shard.head["base"] + starts),
                    pa.array(shard.ends - starts), pa.array(crc, pa.int64()), pa.array(shard.access(shard.ends - 1)), pa.array(own),
                    pa.array(shard.select(T.END_ID, until - 1) - starts),
                ], ["id", "task", "start", "n_tokens", "ids_crc32", "last_id", "n_end_ids", "last_end"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")
    return files.mapInArrow(W.lean(read), f"id {id_type}, task int, start long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long, last_end long")


def round_trip(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` as shards and read them back: the columns of ``read_shards``, ``start`` counted over all documents.

    A document's start is its start within its task's files plus the ids of all earlier tasks, of which there is
    one number each.  An empty table gives no file and no row.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    folder = scratch_path(spark, "wavelet")
    files = stage(write_shards(df, folder, settings, id_col, text_col), "wavelet-files")
    if files.isEmpty():
        return spark.createDataFrame([], f"id {kind}, start long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long, last_end long")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = files.groupBy("task").agg(F.sum("n_tokens").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return read_shards(spark, folder, kind).join(F.broadcast(before), "task").select(
        "id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "last_id", "n_end_ids", "last_end")
