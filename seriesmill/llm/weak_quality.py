"""Quality from weak labels: EM rates overlapping heuristics, and their posterior trains a hashed linear scorer."""

from __future__ import annotations

import re
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

# Each heuristic votes good (1), bad (-1) or abstains (0) from the figures of ``_figures``.
HEURISTICS = {
    "repetition": "CASE WHEN n < 20 THEN 0 WHEN n_distinct < 0.3 * n AND n < 3000 THEN -1 WHEN n_distinct > 0.45 * n THEN 1 ELSE 0 END",
    "top_word": "CASE WHEN n < 20 THEN 0 WHEN top > 0.2 * n THEN -1 WHEN top < 0.12 * n THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN n < 5 THEN 0 WHEN symbols > 0.1 * n THEN -1 WHEN symbols < 0.02 * n THEN 1 ELSE 0 END",
    "capitals": "CASE WHEN letters < 20 THEN 0 WHEN capitals > 0.3 * letters THEN -1 WHEN capitals < 0.1 * letters THEN 1 ELSE 0 END",
    "sentences": "CASE WHEN n < 20 THEN 0 WHEN stops > 0.4 * n OR stops * 80 < n THEN -1 WHEN stops * 40 > n AND stops < 0.25 * n THEN 1 ELSE 0 END",
    "adjacent": "CASE WHEN n < 20 THEN 0 WHEN adjacent > 0.15 * n THEN -1 WHEN adjacent < 0.06 * n THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN n < 20 THEN 0 WHEN word_bytes > 12 * n OR word_bytes < 3 * n THEN -1 WHEN word_bytes < 9 * n THEN 1 ELSE 0 END",
    "short_words": "CASE WHEN n < 50 THEN 0 WHEN short < 0.12 * n THEN -1 WHEN short > 0.25 * n THEN 1 ELSE 0 END",
}
FIGURES = ("n", "n_distinct", "top", "symbols", "letters", "capitals", "stops", "adjacent", "word_bytes", "short")
_SYMBOL, _STOP, _CAPITAL, _LETTER = (
    bytes(1 if chr(b) in kind else 0 for b in range(256))
    for kind in ("#*$%&|<>", ".!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
)


@dataclass(frozen=True)
class Settings:
    """``max_sampled`` bounds the texts that the scorer learns from; EM always covers all texts."""

    rounds: int = 100
    good: float = 0.85  # first guesses: share of good texts, and chances of a bad vote on good and bad ones
    good_blamed: float = 0.02
    bad_found: float = 0.35
    hash_bits: int = 20
    epochs: int = 8
    rate: float = 0.5
    max_sampled: int = 8_000


@dataclass(frozen=True)
class Rated:
    """EM's result: share of good texts and each heuristic's chance of a bad vote given the class."""

    good: float
    blamed: np.ndarray  # [class bad/good, heuristic]: chance that a vote cast is a bad one


def _sums(table: bytes, texts: pa.Array) -> np.ndarray:
    """Bytes of a kind in each text."""
    flags = W.translate(texts, table)
    _, offsets, data = flags.buffers()
    ends = np.frombuffer(offsets, np.int64)[flags.offset : flags.offset + len(flags) + 1]
    running = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8, ends[-1]), dtype=np.int64)]) if ends[-1] else np.zeros(1, np.int64)
    return running[ends[1:]] - running[ends[:-1]]


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The figures behind the heuristics for each text; null counts as empty."""
    words = W.split_words(texts)
    owners, size = words.owners(), max(len(words.vocabulary), 1)
    pairs, counts = np.unique(owners * size + words.codes, return_counts=True)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, pairs // size, counts)
    widths = pc.binary_length(words.vocabulary).to_numpy(zero_copy_only=False)[words.codes]
    per = lambda weights=None, at=owners: np.bincount(at, weights, minlength=len(texts)).astype(np.int64)
    same = np.flatnonzero((words.codes[1:] == words.codes[:-1]) & (owners[1:] == owners[:-1]))
    return {
        "n": per(), "n_distinct": per(at=pairs // size), "top": top, "symbols": _sums(_SYMBOL, texts), "letters": _sums(_LETTER, texts),
        "capitals": _sums(_CAPITAL, texts), "stops": _sums(_STOP, texts), "adjacent": per(at=owners[same]), "word_bytes": per(widths),
        "short": per(at=owners[widths <= 3]),
    }


def _figures(texts: pa.Array) -> pa.Array:
    parts = [figures(block) for _, block in W.blocks(texts)]
    columns = [np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, np.int64) for f in FIGURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(FIGURES))


def with_votes(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``votes`` (array of int), one vote for each heuristic in order."""
    votes = F.expr("array(" + ", ".join(re.sub(r"\b(" + "|".join(FIGURES) + r")\b", r"__f.\1", rule) for rule in HEURISTICS.values()) + ")")
    counted = F.arrow_udf(_figures, ", ".join(f"{f} long" for f in FIGURES))
    return df.withColumn("__f", counted(F.col(text_col))).withColumn("votes", votes).drop("__f")


def rate(patterns: pd.DataFrame, settings: Settings = Settings()) -> Rated:
    """Expectation-maximisation over vote patterns (``votes``, ``rows``).

    The first guess only says that good texts seldom get a bad vote; a tenth of a percent of the rows, as
    imagined votes at that guess, keeps a heuristic from turning round.  Abstentions say nothing.
    """
    table = np.array(patterns["votes"].tolist(), dtype=np.int64).reshape(len(patterns), len(HEURISTICS))
    rows = patterns["rows"].to_numpy(dtype=float)
    bad_votes, cast = table < 0, table != 0
    first = np.tile([[settings.bad_found], [settings.good_blamed]], (1, len(HEURISTICS)))
    rated = Rated(settings.good, first)
    weight = 0.001 * rows.sum() + 1
    for _ in range(settings.rounds):
        good = posterior(table, rated)
        share = np.stack([(1 - good) * rows, good * rows])
        blamed = (share @ bad_votes + first * weight) / (share @ cast + weight)
        rated = Rated(float((share[1].sum() + settings.good * weight) / (rows.sum() + weight)), blamed)
    return rated


def posterior(table: np.ndarray, rated: Rated) -> np.ndarray:
    """Probability of the good class for rows of votes; a row of abstentions gets the share of good texts."""
    bad_votes, good_votes = (table < 0).astype(float), (table > 0).astype(float)
    logs = bad_votes @ np.log(rated.blamed).T + good_votes @ np.log1p(-rated.blamed).T  # [row, class]
    return 1 / (1 + np.exp(np.clip(np.log(1 - rated.good) + logs[:, 0] - np.log(rated.good) - logs[:, 1], -50, 50)))


def _keys(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, key)`` pairs of hashed word shapes: shape, pair of shapes, repeats and the word's end."""
    words = W.split_words(texts, _SHAPES)
    owners, each = words.owners(), words.hashes(1)[words.codes]
    low = np.uint64((1 << bits) - 1)
    parts = [(owners << bits) | (each & low).astype(np.int64)]
    for steps in ((1,), (1, 2)):
        places = W.within(words.offsets, max(steps))
        parts.append((owners[places] << bits) | (W.window_hashes(each, steps)[places] & low).astype(np.int64))
    exact = W.split_words(texts)
    size = max(len(exact.vocabulary), 1)
    _, counts = np.unique(exact.owners() * size + exact.codes, return_counts=True)
    firsts = np.unique(exact.owners() * size + exact.codes) // size
    heavy = np.minimum(np.log2(counts).astype(np.int64), 15)
    parts.append((firsts << bits) | (W.mix((heavy + 7777).astype(np.uint64)) & low).astype(np.int64))
    pairs = np.unique(np.concatenate(parts))
    return pairs >> bits, pairs & ((1 << bits) - 1)


# Letters by case, digits and other bytes to one sign each; marks stay, so a word's shape shows its form.
_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


def _rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in W.blocks(batch.column("text")):
                owners, keys = _keys(texts, bits)
                ends = np.searchsorted(owners, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(start, len(texts)).cast(pa.float64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.astype(np.int32)))], ["label", "keys"])

    return run


@dataclass(frozen=True)
class Scorer:
    bias: float
    weights: np.ndarray
    bits: int


def _descend(rows: list[tuple[float, np.ndarray]], settings: Settings) -> np.ndarray:
    """Logistic weights by adaptive gradient steps on soft labels; the last one is the bias."""
    w, n = np.zeros((1 << settings.hash_bits) + 1), np.full((1 << settings.hash_bits) + 1, 1.0)
    for epoch in range(settings.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            label, keys = rows[k]
            at = np.append(keys, len(w) - 1)
            x = 1 / np.sqrt(len(at))
            slope = (1 / (1 + np.exp(-np.clip(w[at].sum() * x, -35, 35))) - label) * x
            n[at] += slope * slope
            w[at] -= settings.rate * slope / np.sqrt(n[at])
    return w


def fit(docs: DataFrame, settings: Settings = Settings()) -> tuple[Rated, pd.DataFrame, Scorer]:
    """Rates, posterior of every vote pattern, and the scorer, from ``docs`` (``id, text``) without any label.

    All texts vote; they are counted by vote pattern (at most 3 to the power of the number of heuristics
    patterns), and EM runs on those counts.  The scorer learns from a bounded sample.  An empty table
    gives a scorer of 0.5.
    """
    voted = stage(with_votes(docs).select("id", "votes"), "votes")  # texts vote once
    counted = voted.groupBy("votes").agg(F.count("*").alias("rows")).toPandas()
    empty = Scorer(0.0, np.zeros(1 << settings.hash_bits, np.float32), settings.hash_bits)
    if counted.empty:
        return Rated(settings.good, np.zeros((2, len(HEURISTICS)))), counted.assign(posterior=[]), empty
    counted = counted.assign(key=[tuple(v) for v in counted["votes"]]).sort_values("key").reset_index(drop=True)
    rated = rate(counted, settings)
    counted["posterior"] = posterior(np.array(counted["key"].tolist()), rated)
    patterns = docs.sparkSession.createDataFrame(
        [(list(map(int, k)), float(p)) for k, p in zip(counted["key"], counted["posterior"])], "votes array<int>, label double")
    labels = voted.join(F.broadcast(patterns), "votes").select("id", "label")
    sample = bounded_sample(labels, docs, settings.max_sampled)

    def learn(frames):
        seen = [(float(label), np.asarray(keys, dtype=np.int64)) for f in frames for label, keys in zip(f["label"], f["keys"])]
        seen.sort(key=lambda r: (len(r[1]), int(r[1].sum()), r[0]))
        w = _descend(seen, settings)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"key": at, "value": w[at]})

    # Written first: the one task that learns reads features and makes none.
    rows = stage(sample.mapInArrow(W.lean(_rows(settings.hash_bits)), "label double, keys array<int>"), "features")
    learned = rows.coalesce(1).mapInPandas(learn, "key long, value double").toPandas()
    w = np.zeros((1 << settings.hash_bits) + 1, np.float32)
    w[learned["key"]] = learned["value"]
    return rated, counted, Scorer(float(w[-1]), w[:-1], settings.hash_bits)


@W.lean
def score_texts(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    """Probability of good quality for each text."""
    found = []
    for _, block in W.blocks(texts):
        owners, keys = _keys(block, scorer.bits)
        total = np.bincount(owners, scorer.weights[keys], minlength=len(block)) + scorer.bias
        size = np.bincount(owners, minlength=len(block)) + 1
        found.append(1 / (1 + np.exp(-np.clip(total / np.sqrt(size), -35, 35))))
    return np.concatenate(found) if found else np.zeros(0)


def score(scorer: Scorer, text_col: str = "text") -> Column:
    """Score column (double, 0 to 1); null counts as empty."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, scorer))

    return of(F.col(text_col))
