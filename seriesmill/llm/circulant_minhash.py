"""Near duplicates by circulant MinHash: one permutation places shingles, one is shifted for every coordinate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import words as W
from seriesmill.llm.components import components
from seriesmill.llm.tables import split_by_map, stage


@dataclass(frozen=True)
class Settings:
    """``bands`` times ``rows`` coordinates: a pair at the threshold of 0.8 shares no band once in 300,000 times."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    frequent: int = 32  # classes that share a shingle, beyond which it is not looked up as a rare one
    seed: int = 17

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_MASK_LONGS = 8  # a power of two; a column each, as a join condition over array items is too long to be compiled
_MASK = [f"mask{k}" for k in range(_MASK_LONGS)]
_SKETCH_LONGS = 5
# Two bits of each of 160 coordinates.  A pair at 0.8 differs in a tenth of them on average, standard deviation 2 %;
# six deviations more are let through to the exact check.
_SKETCH_SLACK = 0.22


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word windows; shorter texts are one window, empty ones none."""
    words = W.split_words(texts)
    each = words.hashes()[words.codes]
    windows = W.window_hashes(each, tuple(range(1, size)))
    found = []
    for start, end in zip(words.offsets[:-1], words.offsets[1:]):
        if end - start >= size:
            found.append(np.unique(windows[start : end - size + 1]))
        elif end > start:
            found.append(W.window_hashes(each[start:end], tuple(range(1, end - start))))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


class Signer:
    """Signatures from two permutations of the 2**32 places of a circle.

    The permutations are arithmetic, so sets of any size keep their similarity: at a million shingles two of a set
    share a place once in 4,000 shingles.
    """

    def __init__(self, settings: Settings):
        self.settings = settings
        random = np.random.default_rng(settings.seed)
        self.first = np.uint64(random.integers(1 << 63) | 1)
        # Multipliers of a 32-bit mixer of low bias; neighbouring places must not give neighbouring values.
        self.second = [np.uint32(0x21F0AAAD), np.uint32(0x735A2D97)]
        self.shifts = np.arange(settings.coordinates, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate ``k`` is the least value of the second permutation, moved on by ``k``, over the placed shingles."""
        places = (W.mix(shingles * self.first) >> np.uint64(32)).astype(np.uint32)
        best = None
        for start in range(0, len(places), 256):
            x = places[start : start + 256, None] + self.shifts
            x ^= x >> np.uint32(16)
            x *= self.second[0]
            x ^= x >> np.uint32(15)
            x *= self.second[1]
            x ^= x >> np.uint32(15)
            least = x.min(axis=0)
            best = least if best is None else np.minimum(best, least, out=best)
        return best

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """64-bit key of every band; the band's number is part of it."""
        s = self.settings
        parts = signatures.reshape(-1, s.bands, s.rows).astype(np.uint64)
        keys = np.tile(np.arange(1, s.bands + 1, dtype=np.uint64), (len(parts), 1))
        for row in range(s.rows):
            keys = W.mix(keys * np.uint64(0x100000001B3) + parts[:, :, row])
        return keys.view(np.int64)

    def sketch(self, signatures: np.ndarray) -> np.ndarray:
        """Two bits of each coordinate, packed into longs."""
        bits = np.concatenate([signatures >> 16 & 1, signatures >> 17 & 1], axis=1).astype(np.uint8)
        packed = np.packbits(bits, axis=1)
        wanted = _SKETCH_LONGS * 8
        packed = np.pad(packed[:, :wanted], ((0, 0), (0, max(0, wanted - packed.shape[1]))))
        return np.ascontiguousarray(packed).view(np.int64)


def _signed(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(settings)
        for batch in batches:
            for start, texts in W.blocks(batch.column("text"), W.BLOCK_BYTES // 2):
                sets = shingle_sets(texts, settings.shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                signatures = np.stack([signer.signature(sets[k]) for k in full]) if full else np.zeros((0, settings.coordinates), np.uint32)
                width = np.zeros(len(sets), np.int64)
                width[full] = 1
                lists = lambda table: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(width * table.shape[1])]), pa.int32()), pa.array(table.reshape(-1)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(start, len(texts)), batch.column("th").slice(start, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    lists(signer.bands(signatures)), lists(signer.sketch(signatures)),
                ], ["id", "th", "n", "cls", "bands", "sketch"])

    return run


def _alike(percent: int) -> Column:
    """Pairs that can reach the threshold by their set sizes and sketches."""
    differ = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(_SKETCH_LONGS)), F.lit(0))
    return (
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (differ <= int(_SKETCH_SLACK * 64 * _SKETCH_LONGS))
    )


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(
        F.col("cls").alias(side), F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))


def _confirm(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = left.values.to_numpy(), right.values.to_numpy()
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= settings.percent * (len(a) + len(b) - shared))
            chosen = pa.RecordBatch.from_arrays([batch.column("id_a"), batch.column("id_b")], ["a", "b"])
            yield chosen.filter(pa.array(keep, pa.bool_()))

    return run


def _sets(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in W.blocks(batch.column("text")):
                found = [s.view(np.int64) for s in shingle_sets(texts, settings.shingle)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("cls").slice(start, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int64()))], ["cls", "set"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, kind: str, settings: Settings) -> DataFrame:
    """Ids ``a, b`` of those class pairs (``a, b, id_a, id_b``) whose full sets reach the threshold."""
    ends = lambda side: sets.select(F.col("cls").alias(side), F.col("set").alias(f"set_{side}"))
    rows = pairs.join(ends("b"), "b").join(ends("a"), "a").select("id_a", "id_b", "set_a", "set_b")
    return stage(rows.mapInArrow(W.lean(_confirm(settings)), f"a {kind}, b {kind}"), "links")


def _rarity(members: DataFrame, settings: Settings) -> DataFrame:
    """``cls, shared, heavy, first, mask0`` and so on: of each class of ``cls, comp, n, set``, its shared and frequent shingles and its rarest ones.

    Only shingles that some other component has count as shared, and shingles of one component alone come first in the order
    by rarity.  A partner at the threshold shares one of the ``n - t n + 1`` first shingles of both.  ``first`` holds those of
    them that at most ``frequent`` classes have.  Two classes that share none of these share frequent shingles only.
    The masks have a bit for each shared shingle, by its hash.
    """
    each = members.select("cls", "comp", "n", F.explode("set").alias("s"))
    common = each.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("df")).where("low <> high")
    told = each.join(common.select("s", "df"), "s")
    # One row per class again: its shared shingles, of which there are no more than words in its text.
    lists = told.groupBy("cls", "n").agg(
        F.count("*").alias("shared"), F.count(F.when(F.col("df") > settings.frequent, 1)).alias("heavy"),
        F.sort_array(F.collect_list(F.when(F.col("df") <= settings.frequent, F.struct("df", "s")))).alias("light"),
        *(F.coalesce(F.expr(f"bit_or(CASE WHEN (s >> 6) & {_MASK_LONGS - 1} = {k} THEN shiftleft(1L, CAST(s & 63 AS INT)) END)"), F.lit(0)).cast("long").alias(m)
          for k, m in enumerate(_MASK)))
    room = F.col("shared") - F.ceil(F.col("n") * settings.percent / 100) + 1
    return lists.where(room > 0).select("cls", "shared", "heavy", F.slice("light", 1, room.cast("int"))["s"].alias("first"), *_MASK)


def _reachable(percent: int) -> Column:
    """Pairs whose shared shingles, less those that the other's mask shows to be absent there, can reach the threshold."""
    missing = lambda a, b: sum((F.bit_count(F.col(f"{m}_{a}").bitwiseAND(F.bitwise_not(F.col(f"{m}_{b}")))) for m in _MASK), F.lit(0))
    most = F.least(F.col("shared_a") - missing("a", "b"), F.col("shared_b") - missing("b", "a"))
    return (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))


def _rare_pairs(members: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of classes of different components that share one of the first shingles of both."""
    side = lambda s: members.select(
        F.explode("first").alias("s"), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "id", "comp", "n", "shared", "sketch", *_MASK)))
    p = settings.percent
    return side("a").join(side("b"), "s").where((F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & _alike(p) & _reachable(p))


def _frequent_pairs(rows: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of classes of different components in a bucket that could reach the threshold by frequent shingles alone.

    ``rows`` has ``key, cls, id, comp, n, shared, heavy, sketch, bands`` and the masks.  A partner at the threshold is not larger than ``room``.  Classes that no other of
    their bucket can reach leave first; in a large group of copies these are the copies with many changes of their own.
    """
    p = settings.percent
    roomy = rows.withColumn("room", F.floor(F.col("heavy") * (100 + p) / p) - F.col("n")).where("room > 0")
    least = roomy.groupBy("key", "comp").agg(F.min("n").alias("n"), F.max("room").alias("room"), F.count("*").alias("size"))
    # The smallest class and the largest room of each bucket, and those of the bucket's other components.
    order = lambda *by: F.row_number().over(Window.partitionBy("key").orderBy(*by))
    ranked = least.select("*", order(F.asc("n"), "comp").alias("small"), order(F.desc("room"), "comp").alias("wide"))
    pick = lambda which, at, c: F.max(F.when(F.col(which) == at, F.col(c)))
    bucket = ranked.groupBy("key").agg(
        pick("small", 1, "comp").alias("small"), pick("small", 1, "n").alias("n1"), pick("small", 2, "n").alias("n2"),
        pick("wide", 1, "comp").alias("wide"), pick("wide", 1, "room").alias("room1"), pick("wide", 2, "room").alias("room2"),
        F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    alive = roomy.join(bucket, "key").where(
        (F.when(F.col("comp") != F.col("small"), F.col("n1")).otherwise(F.col("n2")) <= F.col("room"))
        & (F.when(F.col("comp") != F.col("wide"), F.col("room1")).otherwise(F.col("room2")) >= F.col("n"))
    ).select("key", "main", "cls", "id", "comp", "n", "room", "shared", "sketch", "bands", *_MASK)
    alive = stage(alive, "open")
    side = lambda s: alive.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "id", "comp", "n", "room", "shared", "sketch", "main", "bands", *_MASK)))
    # A pair that shares several buckets is made in the one of the least key.
    least_key = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("key")
    return side("a").where("comp_a <> main_a").join(side("b"), "key").where(
        (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("main_b")) | (F.col("cls_a") < F.col("cls_b")))
        & (F.col("n_b") <= F.col("room_a")) & (F.col("n_a") <= F.col("room_b")) & _alike(p) & _reachable(p) & least_key)


def near_duplicates(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``id, th, n_shingles, component_id, kept`` (``th`` hashes the text).

    Texts with the same shingle set form a class, led by its smallest id.  In every band's bucket each class is
    compared with one leader; confirmed links make components.  Only buckets that then still hold several
    components are looked at again.  There a pair of different components is compared if it shares a rare shingle among its
    first ones, or could be alike by frequent shingles alone; no other pair can reach the threshold.  A pair is confirmed on its
    full sets.  Every link within a bucket is thus either confirmed or its ends are already in one component.

    Null and empty texts have no shingles and link with nothing.  Rows that share an id but not a text are
    separate; a null id is never a leader and its row is kept.  Other columns of ``df`` are not read.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = dict(docs.dtypes)["id"]
    signed = stage(
        docs.mapInArrow(W.lean(_signed(settings)), f"id {kind}, th long, n long, cls binary, bands array<long>, sketch array<long>"), "signed")
    led = signed.where("cls IS NOT NULL AND id IS NOT NULL").groupBy("cls").agg(
        F.min(F.struct("id", "th")).alias("lead"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stage(led.select("cls", "lead.id", "lead.th", "n", "bands", "sketch"), "classes")
    buckets = classes.select("cls", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("cls").alias("a"), F.count("*").alias("size")).where("size > 1").select("key", "a")
    met = stage(buckets.join(shared, "key"), "met")
    light = classes.drop("bands", "th")
    banded = classes.drop("th")
    sides = lambda pairs: pairs.join(_side(light, "a"), "a").join(_side(light, "b"), "b").where(_alike(settings.percent))
    first = stage(
        sides(met.where("cls <> a").select("a", F.col("cls").alias("b")).distinct()).select("a", "b", "id_a", "id_b"), "pairs")
    wanted = stage(classes.select("cls", "id", "th").join(met.select("cls").distinct(), "cls", "left_semi"), "wanted")
    # Texts that may be asked for move to their classes once; rows that repeat an id and a text are one class.
    may, _ = split_by_map(docs, F.col("th"), wanted.select("th"))
    texts = may.join(wanted, ["id", "th"]).groupBy("cls").agg(F.first("text").alias("text"))
    sets = stage(texts.mapInArrow(W.lean(_sets(settings)), "cls binary, set array<long>"), "sets")
    links = _links(first, sets, kind, settings)
    found = stage(components(links), "components")

    # Buckets that still hold several components besides their leader, which has met everyone.
    owner = banded.join(found, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
    placed = met.where("cls <> a").select("key", "cls").join(owner, "cls")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rows = stage(placed.join(mixed, "key", "left_semi"), "open")
    own = rows.drop("key", "bands").dropDuplicates(["cls"])
    members = stage(own.join(_rarity(own.select("cls", "comp", "n").join(sets, "cls"), settings), "cls"), "rarity")
    ends = lambda pairs: pairs.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "id_a", "id_b")
    later = stage(ends(_rare_pairs(members, settings)).union(
        ends(_frequent_pairs(rows.join(members.select("cls", "shared", "heavy", *_MASK), "cls"), settings))).distinct(), "pairs")
    if not later.isEmpty():
        found = stage(components(links.union(_links(later, sets, kind, settings))), "components")

    labels = classes.join(found, "id", "left").select("cls", F.coalesce("component_id", "id").alias("component_id"))
    return signed.select("id", "th", "n", "cls").join(labels, "cls", "left").select(
        "id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
