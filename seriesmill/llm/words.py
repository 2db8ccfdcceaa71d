"""Words of a column of texts as numpy arrays, and 64-bit hashes of them."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Byte tables of the same length as the text: lower-cased A-Z, and separators made spaces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
LETTERS = bytes(LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Words:
    """``vocabulary[codes[offsets[i]:offsets[i + 1]]]`` are the words of text ``i``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        values = self.vocabulary.cast(pa.binary()).to_pylist()
        return np.fromiter((xxhash.xxh3_64_intdigest(v, seed) for v in values), np.uint64, len(values))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``limit`` bytes (one text at least), so that long ones do not meet in memory.

    What the caller has dropped by the next run is given back.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop
        release()


def release() -> None:
    """Hand freed memory back to the system: a Python worker outlives its task and stands beside the next stage's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not on every system
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of a task (plain or a generator) that gives its memory back when its own variables are gone."""

    @functools.wraps(run)
    def stepwise(*args):
        yield from run(*args)
        release()

    @functools.wraps(run)
    def whole(*args):
        try:
            return run(*args)
        finally:
            release()

    return stepwise if inspect.isgeneratorfunction(run) else whole


def translate(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte through ``table``; null becomes empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    _, offsets, data = texts.buffers()
    moved = pa.py_buffer(bytes(data).translate(table)) if data is not None else pa.py_buffer(b"")
    found = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, offsets, moved], offset=texts.offset)
    return found.cast(pa.large_string(), safe=False)


def split_words(texts: pa.Array, table: bytes = LOWER) -> Words:
    """Words between ASCII white space after ``table`` was applied to every byte."""
    lists = pc.ascii_split_whitespace(translate(texts, table))
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = np.flatnonzero(pc.equal(encoded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(empty):
        keep = codes != empty[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return Words(codes, offsets, encoded.dictionary)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def window_hashes(hashes: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at each place and ``steps`` further on; the last places have none."""
    room = max(len(hashes) - max(steps, default=0), 0)
    total = mix(hashes[:room] + np.uint64(len(steps)))
    for step in steps:
        total = mix(total * np.uint64(31) + hashes[step : step + room] + np.uint64(step))
    return total


def within(offsets: np.ndarray, reach: int) -> np.ndarray:
    """Places whose word and the ``reach`` following ones belong to one text."""
    starts = np.repeat(offsets[1:], np.diff(offsets)) - reach
    return np.flatnonzero(np.arange(len(starts)) < starts)
