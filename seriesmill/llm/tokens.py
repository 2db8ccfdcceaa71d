"""Token ids of texts from a public tokenizer file, one encoding per distinct unit and worker."""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seriesmill.llm import chunks as C
from seriesmill.llm import words as W

END_ID = 1
# Encodings are kept in the Python worker for its later tasks.  Beyond so many units those met in one block only are forgotten.
_KEPT_UNITS = 200_000
_JOINED = 512  # words of letters encoded as one text
_SPECIAL = "<|"
_WORD_END = "</w>"
# The only split of words for which the cuts below are proven.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

# Kinds of bytes: white space, ASCII letters, digits, apostrophe, other ASCII marks, all else.
_SPACE, _LETTER, _DIGIT, _QUOTE, _MARK, _ELSE = range(6)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _ELSE, np.uint8)
    for b in range(0x21, 0x7F):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kinds[ord("'")] = _QUOTE
    kinds[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return kinds


_KINDS = _kinds().tobytes()
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
# Between these kinds a word always ends; an apostrophe may open a contraction, so nothing is cut after it but a digit.
_CUT = np.zeros((6, 6), bool)
_CUT[_LETTER, [_DIGIT, _QUOTE, _MARK]] = _CUT[_DIGIT, [_LETTER, _DIGIT, _QUOTE, _MARK]] = True
_CUT[_MARK, [_LETTER, _DIGIT]] = _CUT[_QUOTE, _DIGIT] = True
_CUT[_SPACE] = True
_OPENS = _CUT.ravel()  # by six times the kind before and the kind


def default_tokenizer() -> str:
    """Path of the vocabulary file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_units(texts: pa.Array, table: bytes) -> W.Words:
    """Stretches without white space that are encoded on their own, after ``table`` was applied to every byte."""
    plain = W.translate(texts, table).cast(pa.large_binary())
    _, offsets, buffer = plain.buffers()
    offsets = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    content = bytes(memoryview(buffer)[offsets[0] : offsets[-1]]) if buffer else b""
    data, offsets = np.frombuffer(content, np.uint8), offsets - offsets[0]
    kinds = np.frombuffer(bytearray(content.translate(_KINDS)), np.uint8)
    # The second byte of U+00C0 to U+00FF stands for a letter, but for the two signs among them.
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    kinds[latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]] = _LETTER
    before = np.full(len(kinds), _SPACE, np.uint8)
    before[1:] = kinds[:-1]
    # The lead of such a letter begins a word after a mark or a digit, as a letter does.
    kinds[latin - 1] = np.where((data[latin] != 0x97) & (data[latin] != 0xB7), _LETTER, _ELSE)
    before *= 6
    before += kinds
    opens = _OPENS[before]
    opens[latin] = False
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    kept = kinds != _SPACE
    opens &= kept
    packed = content.translate(None, _BLANKS)
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    starts = place[np.flatnonzero(opens)]
    bounds = np.append(starts, len(packed)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    encoded = units.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return W.Words(codes, np.searchsorted(starts, place[offsets]), encoded.dictionary.cast(pa.large_string()))


class Encoder:
    """Ids of texts, equal to those of the tokenizer on the whole text.

    The tokenizer drops white space and never joins across it, nor across the cuts of ``split_units``, so a text's ids are
    those of its units, one after the other; each distinct unit is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        self.cuts = _KNOWN_SPLIT in json.dumps(plan["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(_WORD_END) for k in range(self.tokenizer.get_vocab_size())])
        self.place: dict[str, int] = {}
        self.ids, self.lengths, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the units met in more than one block."""
        keep = self.met > 1
        self.ids = self.ids[np.repeat(keep, self.lengths)]
        number = np.cumsum(keep) - 1
        self.place = {u: int(number[k]) for u, k in self.place.items() if keep[k]}
        self.lengths, self.met = self.lengths[keep], np.ones(int(keep.sum()), np.int32)

    def _each(self, units: list[str]) -> list[np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return [np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))]

    def _joined(self, units: list[str]) -> list[np.ndarray]:
        """Words of letters encoded as one text: each ends with the one id that closes a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(units) or (len(ends) and ends[-1] != len(ids) - 1):
            return self._each(units)
        return [ids, np.diff(ends, prepend=-1)]

    def _learn(self, units: list[str]) -> np.ndarray:
        """Encode new units; their places."""
        match = _PLAIN.fullmatch if self.cuts else lambda u: None
        plain, rest = [], []
        for u in units:
            (plain if match(u) else rest).append(u)
        parts = [self._joined(plain[k : k + _JOINED]) for k in range(0, len(plain), _JOINED)]
        parts += [self._each(rest[k : k + 8 * _JOINED]) for k in range(0, len(rest), 8 * _JOINED)]
        self.place.update(zip(plain + rest, range(len(self.place), len(self.place) + len(units))))
        self.ids = np.concatenate([self.ids, *(p[0] for p in parts)])
        self.lengths = np.concatenate([self.lengths, *(p[1] for p in parts)])
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int32)])
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the place where each text starts (one more entry).

        Null is an empty text.  Lower-casing A-Z first changes no id, as the tokenizer lower-cases, unless a
        special token could be written in the text.
        """
        special = pc.any(pc.match_substring(texts, _SPECIAL)).as_py()
        words = split_units(texts, W.LOWER) if self.cuts and not special else W.split_words(texts, bytes(range(256)) if special else W.LOWER)
        distinct = words.vocabulary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
        if len(self.place) > _KEPT_UNITS:
            self._forget()
        place = np.array([self.place.get(w, -1) for w in distinct], np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = self._learn([distinct[k] for k in missing.tolist()])
        self.met[place] += 1
        starts_of = np.cumsum(self.lengths) - self.lengths
        each = place[words.codes]
        counts = self.lengths[each]
        by_word = np.concatenate([[0], np.cumsum(counts)])
        ends = by_word[words.offsets[1:]]
        starts = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        out = np.empty(int(by_word[-1]) + len(ends), np.uint32)
        mask = np.ones(len(out), bool)
        mask[starts[1:] - 1] = False
        out[mask], out[~mask] = self.ids[C.ragged(starts_of[each], counts)], END_ID
        return out, starts


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    kept = sys.modules.setdefault("_seriesmill_worker", types.ModuleType("_seriesmill_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
