"""Arrays of a block of documents, dealt over chunks of a key space and brought back to their block.

A task describes its documents by codes into a dictionary of its own.  What the dictionary's entries are worth over the
whole corpus is found by sending its keys, dealt by chunk, to the tasks of the chunks, which answer entry for entry.  A key
therefore moves once per block and not once per document, whatever its share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "requests array<struct<chunk: int, keys: binary, counts: binary>>"
_REQUEST_TYPE = pa.list_(pa.struct([("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def pack(values: np.ndarray) -> bytes:
    """The array's bytes, compressed; its type is known to the reader."""
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(content: bytes | pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(content.as_py() if isinstance(content, pa.Scalar) else content), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    return pack(np.diff(keys.astype(np.int64), prepend=np.int64(0)))


def unpack_sorted(content: bytes | pa.Scalar) -> np.ndarray:
    return np.cumsum(unpack(content, "<i8"))


def chunk_count(spark: SparkSession, wanted: int | None = None) -> int:
    """``wanted``, or two for each shuffle partition of the session."""
    return wanted or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(keys: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> list[dict]:
    """Requests of one block: ascending ``keys`` with ``counts``, dealt by the chunk that owns each."""
    order = np.argsort(owner, kind="stable")
    found, starts = np.unique(owner[order], return_index=True)
    parts = np.split(order, starts[1:])
    return [{"chunk": int(c), "keys": pack_sorted(keys[p]), "counts": pack(counts[p].astype("<i8"))} for c, p in zip(found, parts)]


def requests(rows: list[list[dict]]) -> pa.Array:
    return pa.array(rows, _REQUEST_TYPE)


def place(owner: np.ndarray) -> dict[int, np.ndarray]:
    """Where each chunk's answers belong among the block's keys."""
    order = np.argsort(owner, kind="stable")
    found, starts = np.unique(owner[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, starts[1:])))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run ``values[offsets[i]:offsets[i + 1]]``; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` with ``lengths[i]`` entries each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def bytes_of(column: pa.Array) -> pa.Array:
    """One array of the texts as bytes; null becomes empty."""
    return pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_binary())])


def chunks_for(texts: DataFrame, text_col: str, chunk_bytes: int) -> int:
    """As many chunks as hold about ``chunk_bytes`` of text each: as the blocks, they follow the data and not the cluster."""
    total = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // chunk_bytes))


def zip_bytes(content: bytes) -> bytes:
    return zstandard.compress(content, 1)


def unzip_bytes(content: bytes | pa.Scalar) -> bytes:
    return zstandard.decompress(content.as_py() if isinstance(content, pa.Scalar) else content)
