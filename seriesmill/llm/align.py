"""Alignment of two tokenizers' tokens by products of token-byte incidence matrices."""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import chunks as C
from seriesmill.llm import csr
from seriesmill.llm import words as W
from seriesmill.llm.tables import stage


_SLICE = 1 << 15  # distinct stretches encoded and linked at a time


@dataclass(frozen=True)
class Settings:
    """Paths of a byte-level BPE file (A) and of a piece model (B); a block holds about ``block_bytes`` of text."""

    byte_tokenizer: str | None = None
    piece_tokenizer: str | None = None
    block_bytes: int = 8 << 20
    chunks: int | None = None


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Tokenizer A: byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.model.encode_special_tokens = True
        alphabet = _byte_alphabet()
        entries = [self.model.id_to_token(k) or "" for k in range(self.model.get_vocab_size())]
        self.bytes = pa.array([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries], pa.large_binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """Tokenizer B: pieces with U+2581 as space and bytes written <0xHH>."""

    # No piece holds a line feed, so a text after one is encoded as in the middle of a text.
    _BEFORE = "\n"

    def __init__(self, path: str | None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = pa.array([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ], pa.large_binary())
        inner = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.skip = len(self.model.encode(self._BEFORE))
        self.cuts = not inner and self.model.encode(self._BEFORE + " a")[: self.skip] == self.model.encode(self._BEFORE)

    def encode(self, texts: list[str], whole: bool) -> list[list[int]]:
        """Ids of texts that begin with the space the model would add; ``whole`` texts are given to it without that space."""
        if whole:
            return self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids[self.skip :] for ids in self.model.encode([self._BEFORE + t for t in texts], num_threads=1)]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places before which both tokenizers end a token, whatever stands around.

    These are: a space or line feed after a character that is surely no white space, and the character after such a line feed
    if it is surely none either.  A tokenizer keeps white space before a word only as a prefix, so nothing joins across.
    """
    low = np.pad(data, (3, 1))
    at = lambda k: low[3 + k : 3 + k + len(data)]
    lead3 = lambda b: (b == 0xE0) | ((b >= 0xE4) & (b <= 0xEF))  # noqa: E731 - E1 to E3 hold white space and U+2581
    visible = (data > 32) & (data < 127)
    tail = (data >= 0x80) & (data < 0xC0)
    ends = visible | (tail & (((at(-1) >= 0xC3) & (at(-1) < 0xE0)) | lead3(at(-2)) | (at(-3) >= 0xF0)))
    begins = visible | ((data >= 0xC3) & (data < 0xE0)) | lead3(data) | (data >= 0xF0)
    after = np.concatenate([[False], ends[:-1]])
    line = (data == 10) & after
    return np.flatnonzero((((data == 32) | (data == 10)) & after) | (np.concatenate([[False], line[:-1]]) & begins))


def split_units(texts: pa.Array, cut: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Space and text of each row in stretches that are encoded on their own: codes, offsets of the rows, distinct stretches."""
    text = lambda x: pa.scalar(x, pa.large_string())
    joined = pc.binary_join_element_wise(text(""), pc.fill_null(texts, "").cast(pa.large_string()), text(" ")).cast(pa.large_binary())
    joined = pa.concat_arrays([joined])
    _, offsets, buffer = joined.buffers()
    offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(buffer, np.uint8)[: offsets[-1]] if buffer else np.zeros(0, np.uint8)
    places = _cuts(data) if cut else np.zeros(0, np.int64)
    starts = np.union1d(offsets[:-1], places[(places >= offsets[0])])
    bounds = np.append(starts, offsets[-1])
    stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), buffer])
    encoded = stretches.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets), encoded.dictionary


@dataclass(frozen=True)
class Links:
    """Tokens of some texts in both vocabularies (``ids``, byte ``lengths``), their groups, and the products of their matrices."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    overlap: csr.Csr
    groups: np.ndarray

    def ending_together(self) -> tuple[np.ndarray, np.ndarray]:
        """Token places of the overlap links whose byte ranges end together."""
        rows, columns = self.overlap.row_of(), self.overlap.indices
        same = self.a_end[rows] == self.b_end[columns]
        return rows[same], columns[same]

    def shared_groups(self) -> csr.Csr:
        """Tokens of both sides that lie in one group."""
        return csr.members(self.a_group, len(self.groups)) @ csr.members(self.b_group, len(self.groups)).T


def link(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> Links:
    """Links of tokens that cover the same bytes: A·Bᵀ over the incidence of tokens and bytes, groups between common ends."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    size = int(a_end[-1]) if len(a_end) else 0
    overlap = csr.runs(a_end - a_len, a_len, size) @ csr.runs(b_end - b_len, b_len, size).T
    both = np.zeros((2, size + 1), bool)
    both[0, a_end], both[1, b_end] = True, True
    common = np.flatnonzero(both.all(axis=0))
    return Links(a, b, a_end, b_end, np.searchsorted(common, a_end), np.searchsorted(common, b_end), overlap, common)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


def _join(parts: pa.Array, counts: np.ndarray, by: str) -> pa.Array:
    """Runs of ``counts`` strings joined by ``by``."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, parts), pa.scalar(by, parts.type))


@dataclass(frozen=True)
class Units:
    """What each distinct stretch of a block holds; ``ok`` is false where a tokenizer's bytes are not the stretch's."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: pa.Array
    pairs: np.ndarray


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, settings: Settings):
        self.a, self.b = ByteTokens(settings.byte_tokenizer), PieceTokens(settings.piece_tokenizer)
        self.a_len, self.b_len = (pc.binary_length(t.bytes).to_numpy(zero_copy_only=False).astype(np.int64) for t in (self.a, self.b))
        pre = str(self.a.model.pre_tokenizer)
        self.cuts = self.b.cuts and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and self.a.model.normalizer is None

    def encode(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        texts = stretches.cast(pa.large_string()).to_pylist()
        return *_flat(self.a.encode(texts)), *_flat(self.b.encode(texts, whole=not self.cuts))

    def _same(self, stretches: pa.Array, ids: np.ndarray, counts: np.ndarray, table: pa.Array) -> np.ndarray:
        """Whether the bytes of the tokens are those of the stretch."""
        return pc.equal(_join(table.take(pa.array(ids)), counts, b""), stretches).to_numpy(zero_copy_only=False)

    def units(self, stretches: pa.Array) -> Units:
        """Links and groups of stretches, some at a time: each is a block of its own on the diagonal of the matrices."""
        parts = [self._units(stretches.slice(k, _SLICE)) for k in range(0, max(len(stretches), 1), _SLICE)]
        merged = {f.name: np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Units) if f.name != "groups"}
        return Units(groups=pa.concat_arrays([p.groups for p in parts]), **merged)

    def _units(self, stretches: pa.Array) -> Units:
        a, n_a, b, n_b = self.encode(stretches)
        ok = self._same(stretches, a, n_a, self.a.bytes) & self._same(stretches, b, n_b, self.b.bytes)
        in_a, in_b = np.repeat(np.arange(len(ok)), n_a), np.repeat(np.arange(len(ok)), n_b)
        a, b, in_a, in_b = a[ok[in_a]], b[ok[in_b]], in_a[ok[in_a]], in_b[ok[in_b]]
        found = link(a, b, self.a_len[a], self.b_len[b])
        rows, columns = found.ending_together()
        count = lambda of: np.bincount(of, minlength=len(ok)).astype(np.int64)
        in_group = np.zeros(len(found.groups), np.int64)
        in_group[found.a_group] = in_a
        text = lambda ids, group: _join(pa.array(ids).cast(pa.large_string()), np.bincount(group, minlength=len(found.groups)), ",")
        each = pc.binary_join_element_wise(text(a, found.a_group), text(b, found.b_group), pa.scalar("|", pa.large_string()))
        n_groups = count(in_group)
        return Units(ok, count(in_a), count(in_b), n_groups, count(in_a[rows]), _join(each, n_groups, ";"), b[columns] << 32 | a[rows])


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _describe(settings: Settings, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(settings), 0
        for batch in batches:
            for start, texts in W.blocks(batch.column("text"), settings.block_bytes):
                codes, offsets, stretches = split_units(texts, aligner.cuts)
                units = aligner.units(stretches)
                row = np.repeat(np.arange(len(texts)), np.diff(offsets))
                bad = np.bincount(row[~units.ok[codes]], minlength=len(texts)) > 0
                none = bad | (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0)
                codes = codes[~none[row]]
                offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, np.diff(offsets)))])
                lists = _join(units.groups.take(pa.array(codes)), np.diff(offsets), ";").to_pylist()
                sha = [hashlib.sha256(s.encode()).hexdigest() if not z else "" for s, z in zip(lists, none)]
                pairs, code = np.unique(units.pairs, return_inverse=True)
                used = np.bincount(codes, minlength=len(units.ok))
                weight = np.bincount(code, np.repeat(used, units.n_links), len(pairs)).astype(np.int64)
                pairs_at = np.concatenate([[0], np.cumsum(units.n_links)])
                counts = [C.sums(getattr(units, c)[codes], offsets) for c in _COUNTS]
                wrap = lambda values, kind: pa.array([values], pa.list_(kind))
                ids = batch.column("id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(wrap(c, pa.int64()) for c in counts), wrap(sha, pa.string()), wrap(offsets, pa.int64()),
                    *(pa.array([C.pack(x.astype("<i4"))], pa.binary()) for x in (codes, code)),
                    pa.array([C.pack(pairs_at)], pa.binary()), pa.array([C.pack_sorted(pairs)], pa.binary()),
                    C.requests([C.deal(pairs, weight, (pairs >> 32) % parts)]),
                ], ["block", "ids", *_COUNTS, "sha", "offsets", "codes", "links", "links_at", "pairs", "requests"])
                number += 1
                del units, stretches, lists, codes, row, code

    return run


def _count(table: pa.Table) -> pa.Table:
    """Corpus-wide counts of a chunk's pairs, answered to each block; a B id's pairs all lie in one chunk."""
    keys = [C.unpack_sorted(k) for k in table.column("keys")]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([C.unpack(c, "<i8") for c in table.column("counts")]), len(found)).astype(np.int64)
    _, first, of = np.unique(found >> 32, return_index=True, return_inverse=True)
    best = total == np.maximum.reduceat(total, first)[of]
    split = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({
        "block": table.column("block"), "chunk": table.column("chunk"),
        "total": pa.array([C.pack(total[p]) for p in np.split(place, split)], pa.binary()),
        "best": pa.array([C.pack(best[p]) for p in np.split(place, split)], pa.binary()),
    })


def _answer(parts: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: blocks.column(c)[0] for c in blocks.column_names}
        pairs = C.unpack_sorted(row["pairs"])
        where = C.place((pairs >> 32) % parts)
        total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for chunk, t, b in zip(answers.column("chunk").to_pylist(), answers.column("total"), answers.column("best")):
            total[where[chunk]], best[where[chunk]] = C.unpack(t, "<i8"), C.unpack(b, "?")
        links, links_at, codes = C.unpack(row["links"], "<i4"), C.unpack(row["links_at"], "<i8"), C.unpack(row["codes"], "<i4")
        offsets = row["offsets"].values.to_numpy()
        per_doc = lambda v: pa.array(C.sums(C.sums(v[links], links_at)[codes], offsets))
        return pa.table({
            "id": row["ids"].values, **{c: row[c].values for c in _COUNTS}, "n_best": per_doc(best), "count_sum": per_doc(total), "groups_sha256": row["sha"].values,
        })

    return run


def align(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Links are the pairs of an A and a B token whose byte ranges end together, read from the product of the incidence matrices;
    groups lie between byte offsets at which tokens of both sides end.  A pair of ids counts its links over all of ``df``.
    ``n_best`` counts links whose pair has the highest count of its B id (ties included), ``count_sum`` adds up the counts.

    Null and empty texts, and texts which a tokenizer does not give back byte for byte, have no tokens: zeros and an empty
    string.  (A tokenizer that changes a text only drops or only adds bytes, so the stretches decide for the text.)  Rows that
    repeat are rows of their own; an empty table gives no row.  Other columns of ``df`` are not read.

    Each distinct stretch of a block is encoded and linked once.  Pairs are counted per block, then by chunks of B ids, which
    answer each block with the counts of its own pairs: no pair moves more than once per block, and nothing is broadcast.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    parts = C.chunk_count(spark, settings.chunks)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"{c} array<long>" for c in _COUNTS)
    blocks = stage(docs.mapInArrow(
        W.lean(_describe(settings, parts)),
        f"block long, ids array<{kind}>, {counts}, sha array<string>, offsets array<long>, codes binary, links binary, links_at binary, pairs binary, {C.REQUEST}",
    ), "align")
    asked = blocks.select("block", F.inline("requests"))
    answers = asked.groupBy("chunk").applyInArrow(_count, "block long, chunk int, total binary, best binary")
    fields = ", ".join(f"{c} long" for c in [*_COUNTS, "n_best", "count_sum"])
    return blocks.drop("requests").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _answer(parts), f"id {kind}, {fields}, groups_sha256 string")


def token_links(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links themselves: ``id, a, b`` (ids of the tokens), ``overlaps`` and ``shared_groups``, one row per row of ``df``.

    ``overlaps`` has the places of an A and a B token and the bytes they share, ``shared_groups`` the places of all pairs in one
    group.  Both are as long as the text asks for; texts without tokens have empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(settings)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                stretches = pa.array([(" " + text).encode()] if text else [], pa.large_binary())
                a, _, b, _ = (*_flat(aligner.a.encode(stretches.cast(pa.large_string()).to_pylist())), *_flat(
                    aligner.b.encode(stretches.cast(pa.large_string()).to_pylist(), whole=True)))
                full = lambda t, ids: b"".join(t.bytes.take(pa.array(ids)).to_pylist()) == b"".join(stretches.to_pylist())
                if not (full(aligner.a, a) and full(aligner.b, b)):
                    a = b = np.zeros(0, np.int64)
                found = link(a, b, aligner.a_len[a], aligner.b_len[b])
                shared = found.shared_groups()
                rows.append((a, b, list(zip(found.overlap.row_of().tolist(), found.overlap.indices.tolist(), found.overlap.data.tolist())),
                             list(zip(shared.row_of().tolist(), shared.indices.tolist()))))
            pair = lambda names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
            named = lambda links, names: [dict(zip(names, x)) for x in links]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([named(r[2], ("a", "b", "bytes")) for r in rows], pair(("a", "b", "bytes"))),
                pa.array([named(r[3], ("a", "b")) for r in rows], pair(("a", "b"))),
            ], ["id", "a", "b", "overlaps", "shared_groups"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, (
        f"id {dict(docs.dtypes)['id']}, a array<long>, b array<long>, overlaps array<struct<a: long, b: long, bytes: long>>, "
        "shared_groups array<struct<a: long, b: long>>"))
