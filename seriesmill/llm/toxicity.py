"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import words as W
from seriesmill.llm.sampling import bounded_sample
from seriesmill.llm.tables import stage

HASH_BITS = 30
STEMS = (4, 6)  # a word also counts by its first letters, so that inflected and compound forms share evidence
STEPS = ((1,), (2,))  # neighbouring words, and words with one word between them
_FILTER_BITS = 22
_BLOCK_BYTES = 1 << 20  # of text whose word pairs meet in memory; they take some fifty times as much


@dataclass(frozen=True)
class Settings:
    """FTRL-proximal rates; ``max_labelled`` bounds the labelled rows that are learned from."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    epochs: int = 6
    min_rows: int = 3  # features in fewer sampled rows are left out
    positive_weight: float = 2.0  # label 1 is the rarer class
    max_labelled: int = 10_000


@dataclass(frozen=True)
class Weights:
    """Non-zero weights of hashed features; L1 keeps them few."""

    bias: float
    keys: np.ndarray
    values: np.ndarray


def _keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _word_kinds(words: W.Words) -> list[np.ndarray]:
    """Feature key of each distinct word and of its stems; -1 where a word is no longer than the stem."""
    found = [_keys(W.mix(words.hashes()))]
    lengths = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)
    for size in STEMS:
        stems = W.Words(words.codes, words.offsets, pc.utf8_slice_codeunits(words.vocabulary, 0, size))
        found.append(np.where(lengths > size, _keys(W.mix(stems.hashes(size))), -1))
    return found


def _gram_keys(words: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and key of every word pair of ``STEPS``."""
    each, owners = words.hashes()[words.codes], words.owners()
    for steps in STEPS:
        places = W.within(words.offsets, max(steps))
        if len(places):
            yield owners[places], _keys(W.window_hashes(each, steps)[places])


def _split(texts: pa.Array) -> W.Words:
    return W.split_words(pc.utf8_lower(texts.cast(pa.large_string())), W.ALNUM)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, key)`` pairs in order of text."""
    words = _split(texts)
    owners, parts = words.owners(), []
    for kind in _word_kinds(words):
        keys = kind[words.codes]
        parts.append((owners[keys >= 0] << HASH_BITS) | keys[keys >= 0])
    parts += [(owner << HASH_BITS) | keys for owner, keys in _gram_keys(words)]
    pairs = np.unique(np.concatenate(parts))
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in W.blocks(batch.column("text"), _BLOCK_BYTES):
            owners, keys = features(texts)
            ends = np.searchsorted(owners, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(start, len(texts)).cast(pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.astype(np.int32)))],
                ["label", "keys"],
            )


def ftrl(rows: list[tuple[int, np.ndarray]], settings: Settings) -> Weights:
    """Weights after ``epochs`` passes over ``(label, keys)`` rows; every feature has its own rate."""
    known, counts = np.unique(np.concatenate([keys for _, keys in rows]), return_counts=True)
    known = known[counts >= settings.min_rows]
    coded: list[tuple[int, np.ndarray]] = []
    for label, keys in rows:
        at = np.searchsorted(known, keys)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == keys)] if len(known) else at[:0]
        coded.append((label, np.append(at, len(known))))  # the last place is the bias
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    l1 = np.full(len(known) + 1, settings.l1)
    l1[-1] = 0

    def weights(at):
        part, bound = z[at], l1[at]
        return np.where(np.abs(part) <= bound, 0, (np.sign(part) * bound - part) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    for epoch in range(settings.epochs):
        for k in np.random.default_rng(epoch).permutation(len(coded)):
            label, at = coded[k]
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            slope *= settings.positive_weight if label else 1
            before, n[at] = np.sqrt(n[at]), n[at] + slope * slope
            z[at] += slope - (np.sqrt(n[at]) - before) / settings.alpha * w
    final = weights(np.arange(len(z)))
    kept = np.flatnonzero(final[:-1])
    return Weights(float(final[-1]), known[kept].astype(np.int64), final[kept])


def fit(labels: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> Weights:
    """Learn from ``labels`` (``id, label`` 0/1) of ``docs`` (``id, text``).

    Features of the sample are made on the executors; one task, which sees at most ``max_labelled`` rows,
    runs the online learner.  Only non-zero weights return.  With one class only, or without any labelled text,
    there are no weights and every score is the smoothed share of label 1 (a quarter without rows).
    """
    sample = bounded_sample(labels, docs, settings.max_labelled)
    # Written first: the one task that learns reads features and makes none.
    rows = stage(sample.mapInArrow(W.lean(_feature_rows), "label int, keys array<int>"), "features")

    def learn(frames):
        seen = [(int(label), np.asarray(keys, dtype=np.int32)) for f in frames for label, keys in zip(f["label"], f["keys"])]
        positive = sum(label for label, _ in seen)
        if 0 < positive < len(seen):
            # Order by content: rows arrive in any order.
            seen.sort(key=lambda r: (len(r[1]), int(r[1].sum(dtype=np.int64)), r[0]))
            found = ftrl(seen, settings)
        else:
            share = (positive + 0.5) / (len(seen) + 2)
            found = Weights(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
        yield pd.DataFrame({"key": np.append(found.keys, -1), "value": np.append(found.values, found.bias)})

    learned = rows.coalesce(1).mapInPandas(learn, "key long, value double").toPandas().sort_values("key")
    if learned.empty:
        return Weights(float(np.log(1 / 3)), np.zeros(0, np.int64), np.zeros(0))
    return Weights(float(learned["value"].iloc[0]), learned["key"].to_numpy()[1:], learned["value"].to_numpy()[1:])


@W.lean
def score_texts(texts: pa.Array, weights: Weights) -> np.ndarray:
    """Probability of label 1 for each text; null counts as empty."""
    if not len(weights.keys):
        return np.full(len(texts), 1 / (1 + np.exp(-weights.bias)))
    low = (1 << _FILTER_BITS) - 1
    likely = np.zeros(1 << _FILTER_BITS, bool)
    likely[weights.keys & low] = True

    def place(keys):
        """Place among the weights, -1 for none."""
        found = np.full(len(keys), -1)
        maybe = np.flatnonzero((keys >= 0) & likely[keys & low])
        at = np.minimum(np.searchsorted(weights.keys, keys[maybe]), len(weights.keys) - 1)
        found[maybe] = np.where(weights.keys[at] == keys[maybe], at, -1)
        return found

    scores = []
    for _, block in W.blocks(texts, _BLOCK_BYTES):
        words = _split(block)
        owners, hits = words.owners(), []
        for kind in _word_kinds(words):
            at = place(kind)[words.codes]
            hits.append(owners[at >= 0] * len(weights.keys) + at[at >= 0])
        for owner, keys in _gram_keys(words):
            at = place(keys)
            hits.append(owner[at >= 0] * len(weights.keys) + at[at >= 0])
        pairs = np.unique(np.concatenate(hits))
        total = np.bincount(pairs // len(weights.keys), weights.values[pairs % len(weights.keys)], minlength=len(block))
        scores.append(1 / (1 + np.exp(-np.clip(total + weights.bias, -35, 35))))
    return np.concatenate(scores) if scores else np.zeros(0)


def score(weights: Weights, text_col: str = "text") -> Column:
    """Score column (double, 0 to 1) of a text column; empty and null texts get the score of the bias."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, weights))

    return of(F.col(text_col))
