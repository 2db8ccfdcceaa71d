"""Benchmark passages in documents, found by one Aho-Corasick automaton over the words of all test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import words as W

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Settings:
    """``max_block_chars`` bounds the items of one automaton; a larger benchmark is scanned for in several blocks."""

    window: int = 13
    max_block_chars: int = 32_000_000


class Automaton:
    """Windows of item words as sequences of word numbers; words of no item are number 0."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = W.split_words(pa.array([text for _, text in items], pa.large_string()), W.ALNUM)
        self.vocabulary = texts.vocabulary
        windows: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            codes = texts.codes[texts.offsets[k] : texts.offsets[k + 1]] + 1
            size = min(window, len(codes))
            for start in range(len(codes) - size + 1 if size else 0):
                windows.setdefault(tuple(codes[start : start + size].tolist()), set()).add(item)
        self.least = min(map(len, windows), default=0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in windows.items():
            self.machine.add_word(key, (len(key), tuple(sorted(names))))
        self.machine.make_automaton()

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, set]]:
        """Words, hit flag of each word, and items found, for each text."""
        words = W.split_words(texts, W.ALNUM)
        found = pc.fill_null(pc.index_in(words.vocabulary, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = found[words.codes]
        # Runs of item words shorter than the shortest window cannot match.
        for start, end in zip(words.offsets[:-1], words.offsets[1:]):
            hit, items = np.zeros(end - start, bool), set()
            if self.least and end - start >= self.least:
                own = codes[start:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (own > 0).view(np.int8), [0]])))
                for low, high in zip(edges[::2], edges[1::2]):
                    if high - low >= self.least:
                        for last, (size, names) in self.machine.iter(tuple(own[low:high].tolist())):
                            hit[low + last - size + 1 : low + last + 1] = True
                            items.update(names)
            yield int(end - start), hit, items


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text under runs of hit words."""
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)  # as long as the text
    places = [m.span() for m in _WORD.finditer(lowered)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]


def item_blocks(benchmark: DataFrame, settings: Settings) -> list[list[tuple[str, str]]]:
    """``(item, text)`` rows in blocks of bounded size.

    The test items come through the driver one partition at a time, and no block exceeds the bound (an item
    longer than that has a block of its own).  Null texts have no words; a null item is named "null".
    """
    blocks, size = [[]], 0
    for row in benchmark.toLocalIterator():
        text = row["text"] or ""
        if size and size + len(text) > settings.max_block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append(("null" if row["item"] is None else str(row["item"]), text))
        size += len(text)
    return blocks


_FOUND = "n_words long, words array<int>, items array<string>, spans array<struct<start: int, end: int>>"


def _scan(items: list[tuple[str, str]], window: int):
    @F.arrow_udf(_FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(items, window)  # once for a task
        for texts in batches:
            rows = []
            for _, block in W.blocks(texts):
                for k, (n, hit, names) in enumerate(automaton.scan(block)):
                    spans = _spans(block[k].as_py(), hit) if names else []
                    rows.append({"n_words": n, "words": np.flatnonzero(hit).tolist(), "items": sorted(names),
                                 "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.array(rows, pa.struct([
                ("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
        del automaton
        W.release()

    return scan


def _merged(text_col: str, words: Column) -> Column:
    """Ranges under the words that any automaton hit."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def ranges(texts: pa.Array, hits: pa.Array) -> pa.Array:
        rows = []
        for text, places in zip(texts.to_pylist(), hits.to_pylist()):
            hit = np.zeros(max(places) + 1 if places else 0, bool)
            hit[places or []] = True
            rows.append([{"start": a, "end": b} for a, b in (_spans(text, hit) if places else [])])
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return ranges(F.col(text_col), words)


def contamination(
    df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text",
) -> DataFrame:
    """Add ``contamination`` to ``df``: a struct of ``n_words, n_hit, items, spans, contaminated`` (in the place of a column of that name).

    ``benchmark`` has ``item, text``.  A text is contaminated when at least one word in twenty lies in an
    occurrence of a window.  ``spans`` are character ranges of the original text under runs of hit words, however the items
    are dealt over automata.  A null or empty text has no words; without items nothing is hit.  Nothing is shuffled.
    """
    parts = []
    for items in item_blocks(benchmark, settings):
        name = f"__scan_{len(parts)}"
        df = df.withColumn(name, _scan(items, settings.window)(F.col(text_col)))
        parts.append(name)
    union = lambda field: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{p}.{field}") for p in parts]))))
    spans = F.col(f"{parts[0]}.spans") if len(parts) == 1 else _merged(text_col, union("words"))
    n_words, n_hit = F.col(f"{parts[0]}.n_words"), F.size(union("words")).cast("long")
    return df.withColumn("contamination", F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), union("items").alias("items"), spans.alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )).drop(*parts)


def items_sha256(items: str) -> Column:
    """Digest of an array of item names, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.col(items)), ","), 256)
