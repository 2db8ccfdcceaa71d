"""Language identification: multinomial naive Bayes over hashed character n-grams of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import words as W
from seriesmill.llm.sampling import bounded_sample

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``buckets`` hashed n-grams of one to ``longest`` characters; ``max_labelled`` bounds the rows learned from."""

    buckets: int = 1 << 16
    longest: int = 4
    smoothing: float = 0.5
    max_labelled: int = 20_000
    max_languages: int = 500


@dataclass(frozen=True)
class Model:
    """``table[b, j]`` is the log-probability of bucket ``b`` in language ``j``."""

    languages: tuple[str, ...]
    priors: np.ndarray
    table: np.ndarray
    longest: int


def _grams(words: W.Words, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of every character n-gram of the distinct words, each word between two spaces."""
    space = pa.scalar(" ", words.vocabulary.type)
    padded = pc.binary_join_element_wise(space, words.vocabulary, space, pa.scalar("", words.vocabulary.type))
    lengths = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # characters to the end of the word
    owners = np.repeat(np.arange(len(lengths)), lengths)
    total, found = np.zeros(len(points), np.uint64), []
    for size in range(1, longest + 1):
        room = max(len(points) - size + 1, 0)
        total = W.mix(total[:room] * np.uint64(31) + points[size - 1 :] + np.uint64(size))
        inside = np.flatnonzero(left[:room] >= size)
        found.append((owners[inside], (total[inside] % np.uint64(buckets)).astype(np.int64)))
    return np.concatenate([o for o, _ in found]), np.concatenate([b for _, b in found])


def _split(texts: pa.Array) -> W.Words:
    """Words of letters; other ASCII characters separate."""
    return W.split_words(pc.utf8_lower(texts.cast(pa.large_string())), W.LETTERS)


def _counts(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            labels = np.asarray(batch.column("label").to_pylist(), dtype=object)
            for start, texts in W.blocks(batch.column("text")):
                words = _split(texts)
                owner, bucket = _grams(words, buckets, longest)
                langs, code = np.unique(labels[start : start + len(texts)], return_inverse=True)
                for j, lang in enumerate(langs):
                    used = np.bincount(words.codes[code[words.owners()] == j], minlength=len(words.vocabulary))
                    part = np.bincount(bucket, used[owner], minlength=buckets)
                    totals[lang] = totals.get(lang, 0) + part
                    documents[lang] = documents.get(lang, 0) + int((code == j).sum())
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "label": [lang] * (len(at) + 1), "bucket": pa.array(np.append(at, -1), pa.int64()),
                "n": pa.array(np.append(total[at], documents[lang]), pa.float64()),
            })

    return run


def fit(labels: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``labels`` (``id, label``) of ``docs`` (``id, text``).

    N-grams are counted on the executors, one row per language and bucket comes out of a task, and the sums
    (at most ``max_languages * buckets`` numbers, else an error) make the matrix.
    """
    sample = bounded_sample(labels, docs, settings.max_labelled)
    counts = (
        sample.mapInArrow(_counts(settings.buckets, settings.longest), "label string, bucket long, n double")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    )
    packed = counts.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(settings.max_languages + 1).toArrow()
    if packed.num_rows > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    found = sorted(zip(packed["label"].to_pylist(), range(packed.num_rows)))
    table, documents = np.zeros((settings.buckets, len(found))), np.zeros(len(found))
    for j, (_, row) in enumerate(found):
        pairs = packed["c"][row].values
        at = pairs.field("bucket").to_numpy(zero_copy_only=False)
        n = pairs.field("n").to_numpy(zero_copy_only=False)
        documents[j] = n[at < 0].sum()
        table[at[at >= 0], j] = n[at >= 0]
    table += settings.smoothing
    table = np.log(table) - np.log(table.sum(axis=0))
    priors = np.log((documents + 1) / (documents.sum() + len(found))) if found else documents
    return Model(tuple(lang for lang, _ in found), priors, table.astype(np.float32), settings.longest)


def predict_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    langs, scores = [], []
    for _, block in W.blocks(texts):
        words = _split(block)
        lettered = pc.match_substring_regex(words.vocabulary, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        counted = np.bincount(words.owners()[lettered[words.codes]], minlength=len(words))
        if not model.languages:
            langs += [UNKNOWN] * len(block)
            scores.append(np.zeros(len(block)))
            continue
        owner, bucket = _grams(words, len(model.table), model.longest)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words.vocabulary)))
        by_word = np.add.reduceat(model.table[bucket[order]].astype(np.float64), starts) if len(order) else np.zeros((0, len(model.languages)))
        total = np.tile(model.priors, (len(block), 1))
        for j in range(len(model.languages)):
            total[:, j] += np.bincount(words.owners(), by_word[words.codes, j], minlength=len(block))
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs += [model.languages[b] if n else UNKNOWN for b, n in zip(best, counted)]
        scores.append(np.where(counted > 0, share, 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(model: Model, text_col: str = "text") -> Column:
    """Struct ``lang_pred, score``; ``und`` with score 0 for null, for texts without a letter and for an empty model.

    Equal posteriors go to the language first in the alphabet.
    """

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores = predict_texts(texts, model)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return of(F.col(text_col))
