"""Spelling variants: words one insertion, deletion or replacement apart, by a dictionary of trie-node pairs."""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import words as W
from seriesmill.llm.tables import stage


@dataclass(frozen=True)
class Settings:
    """Words of at least ``min_length`` code points and ``min_count`` occurrences; ``noise`` is the divisor of the deletion rule (0: none)."""

    min_length: int = 5
    min_count: int = 3
    noise: int = 97


def letter_runs(texts: pa.Array) -> W.Words:
    """Maximal runs of ``A-Z a-z U+00C0-U+00FF``, with A-Z lower-cased."""
    plain = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    _, offsets, buffer = plain.buffers()
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    lead = data == 0xC3
    inside = np.concatenate([[False], lead[:-1]])
    lower = data | 0x20
    letter = (lower >= 97) & (lower <= 122)
    kept = np.where(letter, lower, np.where(lead | inside, data, 32)).astype(np.uint8)
    found = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, offsets, pa.py_buffer(kept)], offset=plain.offset)
    return W.split_words(found.cast(pa.large_string()), bytes(range(256)))


def _counter(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in W.blocks(batch.column("text"), 2 * W.BLOCK_BYTES):
                names = batch.column("id").slice(start, len(texts)).to_pylist()
                found = letter_runs(texts)
                size = len(found.vocabulary)
                lengths = pc.utf8_length(found.vocabulary).to_numpy(zero_copy_only=False)
                counts = np.bincount(found.codes, minlength=size).astype(np.int64)
                changed: dict[str, int] = {}
                if settings.noise:  # a deletion only shortens, so shorter runs are left out at once
                    long = lengths[found.codes] >= settings.min_length
                    met, times = np.unique((found.owners() * size + found.codes)[long], return_counts=True)
                    heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in names]
                    content = found.vocabulary.cast(pa.binary()).to_pylist()
                    owner, code = np.divmod(met, max(size, 1))
                    hashes = np.fromiter(map(zlib.crc32, map(content.__getitem__, code.tolist()), map(heads.__getitem__, owner.tolist())), np.int64, len(met))
                    for k in np.flatnonzero(hashes % settings.noise == 0):
                        word = content[code[k]].decode()
                        at = int(hashes[k]) % len(word)
                        short = word[:at] + word[at + 1 :]
                        changed[short] = changed.get(short, 0) + int(times[k])
                        counts[code[k]] -= times[k]
                keep = np.flatnonzero((lengths >= settings.min_length) & (counts > 0))
                yield pa.RecordBatch.from_arrays([found.vocabulary.take(pa.array(keep)).cast(pa.string()), pa.array(counts[keep])], ["word", "n"])
                extra = {w: n for w, n in changed.items() if len(w) >= settings.min_length}
                yield pa.RecordBatch.from_arrays([pa.array(list(extra), pa.string()), pa.array(list(extra.values()), pa.int64())], ["word", "n"])

    return run


def word_counts(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words that count; a null id stands as nothing in the deletion rule, null texts have no words."""
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return docs.mapInArrow(W.lean(_counter(settings)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.min_count)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the trie nodes on the way to each of the sorted words; nodes shared with the word before keep their number."""
    part, before, path, nodes = TaskContext.get().partitionId(), "", [], 0
    for batch in batches:
        keys, paths = batch.column("key").to_pylist(), []
        for key in keys:
            shared = len(os.path.commonprefix((before, key)))
            path = path[:shared] + list(range(nodes, nodes + len(key) - shared))
            nodes += len(key) - shared
            before = key
            paths.append(path)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        flat = np.fromiter(itertools.chain.from_iterable(paths), np.int64, int(offsets[-1]))
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in batch.schema.names), pa.array(np.full(len(keys), part, np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
        ], [*batch.schema.names, "part", "path"])


def trie(words: DataFrame, key: Column) -> DataFrame:
    """``words`` with ``path``: the numbers, from 1, of the nodes of the prefixes of ``key``; keys must be distinct.

    Words are sorted over all partitions and each partition numbers the nodes that its words open.  Only the outermost words
    of a partition reach the driver, which joins the nodes that two partitions share.  Numbers of last nodes ascend
    with the words in code-point order.
    """
    spark, names = words.sparkSession, words.columns
    parted = words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key")
    fields = ", ".join(f"{c} {t}" for c, t in parted.dtypes)
    walked = stage(parted.mapInArrow(_walk, f"{fields}, part int, path array<long>"), "trie")
    ends = walked.groupBy("part").agg(
        F.min("key").alias("first"), F.max(F.struct("key", "path")).alias("last"), F.max(F.element_at("path", -1)).alias("top")).orderBy("part").collect()
    offset, before, above, joints = 1, "", [], []
    for row in ends:
        shared = above[: len(os.path.commonprefix((before, row["first"])))]
        joints.append((row["part"], offset, shared))
        place = lambda k: shared[k] if k < len(shared) else k + offset  # noqa: B023, E731
        before, above = row["last"]["key"], [place(k) for k in row["last"]["path"]]
        offset += row["top"] + 1
    table = spark.createDataFrame(joints, "part int, offset long, shared array<long>")
    number = F.transform("path", lambda k: F.when(k < F.size("shared"), F.get("shared", k.cast("int"))).otherwise(k + F.col("offset")))
    return walked.join(F.broadcast(table), "part").select(*names, number.alias("path"))


_INTACT, _INNER, _HEAD = 0, 1, 2


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a prefix node and a suffix node: around each skipped letter, and at each place of the intact word.

    Of a run of equal letters only the first is a head: skipping any of them gives the same word.
    """
    for batch in batches:
        words = batch.column("word").to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        front, back = (np.concatenate([[0], batch.column(c).flatten().to_numpy()]) for c in ("front", "back"))

        def node(numbers: np.ndarray, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
            return np.where(depth > 0, numbers[np.where(depth > 0, starts[row] + depth, 0)], 0)

        rows, places, kinds, rest = [], [], [], []
        for kind, extra in ((_HEAD, 0), (_INTACT, 1)):
            row = np.repeat(np.arange(len(words)), lengths + extra)
            at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(lengths + extra)])[:-1], lengths + extra)
            rows.append(row), places.append(at), rest.append(lengths[row] - at - (1 - extra))
            if kind == _HEAD:
                same = np.concatenate([[False], letters[1:] == letters[:-1]]) & (at > 0)
                kinds.append(np.where(same, _INNER, _HEAD))
            else:
                kinds.append(np.zeros(len(row), np.int64))
        row, at, left = np.concatenate(rows), np.concatenate(places), np.concatenate(rest)
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays([
            pa.array(node(front, row, at)), pa.array(node(back, row, left)), batch.column("id").take(own), batch.column("n").take(own),
            pa.array(np.concatenate(kinds).astype(np.int8)),
        ], ["f", "r", "id", "n", "kind"])


def neighbours(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` of words ``id, word, n, front, back`` that have a near word; ``best`` is ``(n, -id)`` of the foremost one.

    In a pair's bucket the words that skip a letter differ from one another in that letter only, so there are at most as many as
    letters, and at most one intact word.  Each member's near words are counted from the bucket's size and its
    two foremost members; no pairs of words are made.
    """
    keyed = words.select("id", "word", "n", "front", "back").mapInArrow(_pairs, "f long, r long, id long, n long, kind byte")
    member = F.struct("n", (-F.col("id")).alias("m"), "kind")
    buckets = keyed.groupBy("f", "r").agg(F.sort_array(F.collect_list(member), asc=False).alias("x")).where("size(x) > 1")
    split = buckets.select(
        F.filter("x", lambda s: s["kind"] != _INTACT).alias("skip"), F.filter("x", lambda s: s["kind"] == _HEAD).alias("head"),
        F.get(F.filter("x", lambda s: s["kind"] == _INTACT), F.lit(0)).alias("whole"))
    rank = lambda s: F.struct(s["n"].alias("n"), s["m"].alias("m"))
    none = F.lit(None).cast("struct<n: bigint, m: bigint>")
    around = F.transform("skip", lambda s: F.struct(
        s["m"].alias("m"),
        (F.size("skip") - 1 + ((s["kind"] == _HEAD) & F.col("whole").isNotNull()).cast("int")).alias("near"),
        F.greatest(
            F.when(F.size("skip") > 1, rank(F.when(F.col("skip")[0]["m"] == s["m"], F.get("skip", F.lit(1))).otherwise(F.col("skip")[0]))).otherwise(none),
            F.when((s["kind"] == _HEAD) & F.col("whole").isNotNull(), rank(F.col("whole"))).otherwise(none)).alias("best")))
    centre = F.when(F.col("whole").isNotNull() & (F.size("head") > 0), F.array(F.struct(
        F.col("whole")["m"].alias("m"), F.size("head").alias("near"), rank(F.get("head", F.lit(0))).alias("best")))).otherwise(F.array())
    each = split.select(F.explode(F.concat(around, centre)).alias("e")).where("e.near > 0")
    return each.groupBy((-F.col("e.m")).alias("id")).agg(F.sum("e.near").alias("n_near"), F.max("e.best").alias("best"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``id, root`` where ``forms`` (``id, form``) end; each round doubles the steps taken."""
    current = stage(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(max(math.ceil(math.log2(max(steps, 1))), 0)):
        on = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        current = stage(current.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
    return current


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct ``word, n``, one row per word.

    Near words differ by exactly one inserted, deleted or replaced code point.  The form is the near word with the largest
    ``n`` (ties: first in code-point order) if that is at least twice the word's own; the root is where the forms lead.  A word
    without near words has 0, null and itself.  An empty table gives no row; null words are left out.
    """
    front = trie(words.where("word IS NOT NULL").select("word", "n"), F.col("word")).withColumnRenamed("path", "front")
    back = trie(words.where("word IS NOT NULL").select("word"), F.reverse("word")).withColumnRenamed("path", "back")
    known = stage(front.join(back, "word").withColumn("id", F.element_at("front", -1)), "words")
    near = known.select("id", F.col("n").alias("own")).join(neighbours(known), "id")
    far = F.col("best.n") >= 2 * F.col("own")
    found = stage(near.select("id", "n_near", F.when(far, -F.col("best.m")).alias("form"), F.when(far, F.col("best.n")).alias("form_n")), "near")
    forms = found.where("form IS NOT NULL")
    # Every step at least doubles n, so chains have no more steps than the largest n has binary digits.
    largest = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(forms.select("id", "form"), int(largest).bit_length())
    spelt = known.select("id", "word")
    return (
        known.select("id", "word", "n").join(found, "id", "left").join(roots, "id", "left")
        .join(spelt.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form", "left")
        .join(spelt.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root", "left")
        .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def spelling_variants(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants among the words of a table of texts; see ``word_counts`` and ``variants``.  Other columns are not read."""
    return variants(stage(word_counts(df, settings, id_col, text_col), "counts"))
