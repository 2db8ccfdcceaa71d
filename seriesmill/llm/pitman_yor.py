"""Hierarchical Pitman-Yor language model of word pairs, learned and applied over chunks of the corpus.

Every word is a restaurant of the words that follow it; all these restaurants share one parent, whose customers are
their tables, and the parent's base is uniform over the vocabulary and one unknown word.  Seating is sampled by Gibbs steps:
all customers of a dish (or one at a time) leave and take their seats again by the restaurant's rule.  Restaurants are seated in
parallel, each given the parent's probabilities and table counts of the last round, as in distributed samplers of topic models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import chunks as C
from seriesmill.llm import words as W
from seriesmill.llm.tables import stage

# What tasks send each other: packed arrays from a sender to a receiver, and sums that the driver adds up.
LETTER = "sender long, receiver long, body array<binary>, sums array<double>"
_STATE = -1  # receiver of what a task keeps for itself
_SEATS = -3  # receiver of the seating a chunk of restaurants keeps
_SLICE = 1 << 20  # tokens scored at a time
_LISTED = 1024  # customers up to which a dish's tables are drawn from a list of Stirling numbers
_NODES = 48  # of the contour integral for dishes with more
_END = ""    # the token after each text, and the context of its first word


@dataclass(frozen=True)
class Settings:
    """``rounds`` exchange counts between restaurants and parent; each after the first ``burn`` gives one sample.

    A block holds about ``block_bytes`` of text; words and pairs are dealt over a chunk for each ``chunk_bytes`` (or over
    ``chunks``).  A round has ``sweeps``, in each of which all customers of every dish take their seats anew at once (or ``moves`` of them, one by one).  Discounts are
    estimated from the numbers of pairs (and of words by contexts) met once and twice.  The dishes of a word with more than
    ``shard_tokens`` successors are dealt over several chunks.
    """

    block_bytes: int = 32 << 20
    chunk_bytes: int = 10 << 20
    chunks: int | None = None
    rounds: int = 3
    burn: int = 1
    sweeps: int = 3
    moves: int | None = None
    strength: float = 1.0
    shard_tokens: int = 500_000
    seed: int = 29


def training_rows(id_col: str = "doc_id") -> Column:
    """True for six of seven ids, by ``crc32`` of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 != 2, F.lit(False))


# Blocks of documents

def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words, each text followed by the end token (code 0); offsets of the texts; the words of the codes."""
    vocabulary, codes, counts = {_END: 0}, [], []
    for _, part in W.blocks(texts):
        words = W.split_words(part)
        names = words.vocabulary.to_pylist()
        place = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in names), np.int32, len(names))
        ends = words.offsets[1:] + np.arange(1, len(part) + 1)
        out = np.zeros(len(words.codes) + len(part), np.int32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = place[words.codes]
        codes.append(out), counts.append(np.diff(words.offsets) + 1)
        del words, names
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return np.concatenate(codes) if codes else np.zeros(0, np.int32), offsets, list(vocabulary)


def _describe(settings: Settings, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for start, texts in W.blocks(batch.column("text"), settings.block_bytes):
                codes, offsets, names = _tokens(texts)
                train = batch.column("train").slice(start, len(texts))
                learned = np.repeat(train.to_numpy(zero_copy_only=False), np.diff(offsets))
                counts = np.bincount(codes[learned], minlength=len(names))
                content = [w.encode() for w in names]
                owner = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in content), np.int32, len(content))
                rows = [{
                    "chunk": chunk, "keys": C.zip_bytes(b"\n".join(content[k] for k in at.tolist())), "counts": C.pack(counts[at].astype("<i8")),
                } for chunk, at in C.place(owner).items()]
                ids = batch.column("id").slice(start, len(texts))
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), whole(ids), whole(train),
                    *(pa.array([x], pa.binary()) for x in (C.pack_sorted(offsets), C.pack(codes), C.pack(owner))), C.requests([rows]),
                ], ["block", "ids", "train", "offsets", "codes", "owner", "requests"])
                number += 1
                del codes, names, learned, content, owner, rows

    return run


def _letter(sender: int, receiver: int, *body: bytes, sums: tuple = ()) -> dict:
    return {"sender": int(sender), "receiver": int(receiver), "body": list(body), "sums": [float(s) for s in sums]}


_LETTERS = pa.schema([("sender", pa.int64()), ("receiver", pa.int64()), ("body", pa.list_(pa.binary())), ("sums", pa.list_(pa.float64()))])


def _letters(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _LETTERS)


def _vocabulary(key: tuple, table: pa.Table) -> pa.Table:
    """Numbers the trained words of a chunk and answers each block: number (or -1) and training count of its words."""
    keys = [pa.array(C.unzip_bytes(k).decode().split("\n"), pa.string()) for k in table.column("keys")]
    encoded = pa.concat_arrays(keys).dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(code, np.concatenate([C.unpack(c, "<i8") for c in table.column("counts")]), len(encoded.dictionary)).astype(np.int64)
    order = pc.sort_indices(encoded.dictionary).to_numpy()  # the same numbers whatever the order of the letters
    trained = order[total[order] > 0]
    number = np.full(len(total), -1, np.int32)
    number[trained] = np.arange(len(trained))
    rows = [_letter(key[0].as_py(), _STATE, C.pack(total[trained]), sums=(len(trained), total.sum()))]
    at = 0
    for block, words in zip(table.column("block").to_pylist(), keys):
        own = code[at : at + len(words)]
        rows.append(_letter(key[0].as_py(), block, C.pack(number[own]), C.pack(total[own].astype("<i8"))))
        at += len(words)
    return _letters(rows)


@dataclass(frozen=True)
class Corpus:
    """Vocabulary size, training tokens, the first word number of each chunk (and the end), and the settings."""

    words: int
    tokens: int
    firsts: np.ndarray
    parts: int
    settings: Settings

    def chunk_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, ids, "right") - 1

    def owner_of(self, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The chunk of a pair: all pairs of a context are together unless it has very many successors."""
        shards = c // self.settings.shard_tokens + 1
        return (u + W.mix(w.astype(np.uint64)).astype(np.int64) % shards) % self.parts


class Block:
    """The tokens of a block by word number: ``ids`` (-1: not trained) and ``counts`` of its distinct words, ``codes`` of its tokens."""

    def __init__(self, table: pa.Table, letters: list[tuple[int, list[pa.Scalar]]], corpus: Corpus):
        row = {c: table.column(c)[0] for c in table.column_names}
        self.name = row["block"].as_py()
        self.codes, self.offsets = C.unpack(row["codes"], "<i4"), C.unpack_sorted(row["offsets"])
        self.train = row["train"].values.to_numpy(zero_copy_only=False)
        self.rows = row
        where = C.place(C.unpack(row["owner"], "<i4"))
        size = sum(map(len, where.values()))
        self.ids, self.counts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.where = where
        for chunk, body in letters:
            number, counts = C.unpack(body[0], "<i4"), C.unpack(body[1], "<i8")
            self.ids[where[chunk]] = np.where(number >= 0, number + corpus.firsts[chunk], -1)
            self.counts[where[chunk]] = counts

    def contexts(self) -> np.ndarray:
        """The code of the word before each token; the end token stands before a text's first word."""
        before = np.concatenate([np.zeros(1, np.int32), self.codes[:-1]])
        before[self.offsets[:-1]] = 0
        return before

    def pairs(self, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending keys of the pairs of trained words, training occurrences, owning chunk; and each token's place among them or -1."""
        before = self.contexts()
        known = (self.ids[before] >= 0) & (self.ids[self.codes] >= 0)
        key = self.ids[before]
        key *= corpus.words
        key += self.ids[self.codes]
        keys, place = np.unique(key[known], return_inverse=True)
        del key
        out = np.full(len(known), -1, np.int32)
        out[known] = place
        del place
        learned = np.repeat(self.train, np.diff(self.offsets)) & known
        counts = np.bincount(out[learned], minlength=len(keys)).astype(np.int64)
        of_context = np.zeros(len(keys), np.int64)
        of_context[out[known]] = self.counts[before[known]]
        return keys, counts, corpus.owner_of(*np.divmod(keys, corpus.words), of_context), out


def _bodies(table: pa.Table) -> list[tuple[int, list[pa.Scalar]]]:
    return [(s, list(b.values)) for s, b in zip(table.column("sender").to_pylist(), table.column("body"))]


def _ask(corpus: Corpus):
    def run(blocks: pa.Table, letters: pa.Table) -> pa.Table:
        block = Block(blocks, _bodies(letters), corpus)
        keys, counts, owner, _ = block.pairs(corpus)
        W.release()
        return _letters([
            _letter(block.name, chunk, C.pack_sorted(keys[at]), C.pack(counts[at].astype("<i4"))) for chunk, at in C.place(owner).items()])

    return run


# Restaurants

def _log_stirling(discount: float, counts: np.ndarray) -> dict[int, np.ndarray]:
    """For each of ``counts`` the logarithms of the weights of its seatings with 1, 2, ... tables, the tables' own weight apart."""
    wanted, rows, row = set(counts.tolist()), {}, np.zeros(1)
    for c in range(1, max(wanted, default=0) + 1):
        if c > 1:  # the last customer sits down at one of the tables, or alone
            row = np.logaddexp(np.append(row + np.log(c - 1 - discount * np.arange(1, c)), -np.inf), np.append(-np.inf, row))
        if c in wanted:
            rows[c] = row
    return rows


def _boltzmann(counts: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """``y = 1 - z`` where Poisson tables, those of ``n`` customers tilted by ``z**n``, have ``counts`` customers on average."""
    low, high = np.full(len(counts), -700.0), np.zeros(len(counts))
    for _ in range(60):
        middle = (low + high) / 2
        more = weight * -np.expm1(middle) * np.exp((discount - 1) * middle) > counts
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return np.exp((low + high) / 2)


def _table_moments(weight: np.ndarray, discount: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of those tables: mean number; sum of the customers' means; sum of the means of their squares."""
    slope = (1 - y) * y ** (discount - 1)
    return weight * (1 - y**discount) / discount, weight * slope, weight * (slope + (1 - y) ** 2 * (1 - discount) * y ** (discount - 2))


def table_shares(count: int, weight: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables that a dish of many customers can have, and their probabilities (to about 1e-8), at a cost that hardly grows with ``count``.

    The seatings with ``t`` tables weigh ``weight**t / t!`` times the ``count``-th coefficient of ``((1 - (1 - z)**d) / d)**t``, a contour
    integral: along a parabola in ``log z`` around the cut from ``z = 1``, or a whole circle where most tables have one customer.
    Numbers further than nine deviations from the mean are left out; their share is below rounding.
    """
    d, own = discount, _boltzmann(np.array([count]), np.array([weight]), discount)[0]
    mean, first, second = _table_moments(weight, d, own)
    reach = 9 * math.sqrt(max(mean - first * first / second, 0)) + 24
    t = np.arange(max(1, math.floor(mean - reach)), min(count, math.ceil(mean + reach)) + 1)
    y = min(max(own, 5 / count), 1 - 1e-12)
    mean, first, second = _table_moments(weight, d, y)
    vertex, spread = -math.log1p(-y), math.sqrt(max(second - first * first / mean, 0))
    if y > 0.05 and spread < 60:
        nodes = int(12 * spread) + _NODES
        s, lead = vertex + 1j * np.pi * (np.arange(nodes) + 0.5) / nodes, 0.0
    else:
        reach = max(6 / math.sqrt(count * vertex), 4 / math.sqrt(count * vertex * (1 - d)), 5 / (vertex * spread) if y > 0.05 else 0)
        bow = 1 + 1j * (np.arange(_NODES) + 0.5) * reach / _NODES
        s, lead = vertex * bow**2, np.log(bow)
    each = np.log(-np.expm1(d * np.log(-np.expm1(-s))) / d)
    logs = np.cumsum(np.log(weight / t))[:, None] + (t - t[0])[:, None] * each + (count * s + t[0] * each + lead)
    shares = np.maximum(np.exp(logs - logs.real.max()).real.sum(axis=1), 0)
    return t, shares / shares.sum()


def draw_tables(counts: np.ndarray, discount: float, weight: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes all of whose customers take seats anew, from their exact distribution given ``weight``, that of a new table."""
    out = np.ones(len(counts), np.int64)
    order = np.argsort(counts, kind="stable")
    found, starts = np.unique(counts[order], return_index=True)
    listed = _log_stirling(discount, found[found <= _LISTED])
    for count, rows in zip(found.tolist(), np.split(order, starts[1:])):
        if count in listed:
            for at in np.array_split(rows, max(1, len(rows) * count >> 19)):
                steps = listed[count] + np.log(weight[at])[:, None] * np.arange(1, count + 1)
                steps = np.cumsum(np.exp(steps - steps.max(axis=1, keepdims=True)), axis=1)
                seen = (steps <= (random.random(len(at)) * steps[:, -1])[:, None]).sum(axis=1)
                out[at] = np.minimum(seen + 1, count)
        else:
            for at in rows.tolist():
                t, shares = table_shares(count, float(weight[at]), discount)
                steps = np.cumsum(shares)
                out[at] = t[min(int(np.searchsorted(steps, random.random() * steps[-1], "right")), len(t) - 1)]
    return out


class Seating:
    """Tables of many dishes, and Gibbs steps on all of them at a time.

    For steps of single customers the sizes of the tables are held in matrices, dishes together by the room they need.
    A dish served once has one table and is not held.
    """

    def __init__(self, counts: np.ndarray, tables: np.ndarray, sizes: np.ndarray | None = None):
        self.counts, self.tables, self._sizes = counts, tables.copy(), sizes

    @cached_property
    def groups(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Dishes and the sizes of their tables."""
        counts, tables, sizes = self.counts, self.tables, self._sizes
        room = np.minimum(counts, 1 << np.ceil(np.log2(2 * tables + 4)).astype(np.int64)) if len(counts) else counts
        starts = np.cumsum(tables) - tables
        groups = []
        for width in np.unique(room):
            rows = np.flatnonzero(room == width)
            held = np.zeros((len(rows), int(width)), np.int32)
            taken = np.arange(width) < tables[rows, None]
            if sizes is None:  # one large table and customers who sit alone
                held[taken] = 1
                held[:, 0] = counts[rows] - tables[rows] + 1
            else:
                held[taken] = sizes[C.ragged(starts[rows], tables[rows])]
            groups.append((rows, held))
        return groups

    def sizes(self) -> np.ndarray:
        """Sizes of all tables, dish after dish; after a sweep of all customers at once, which draws none, those of an opening."""
        out = np.zeros(int(self.tables.sum()), np.int32)
        starts = np.cumsum(self.tables) - self.tables
        for rows, held in self.groups:
            taken = held > 0
            out[C.ragged(starts[rows], self.tables[rows])] = held[taken]
        return out

    def sweep(self, discount: float, weight: np.ndarray, moves: int | None, random: np.random.Generator) -> None:
        """``weight`` is that of a new table for each dish; an old one of ``n`` customers weighs ``n - discount``.

        All customers of a dish leave and sit down again at once, which draws its tables whatever they were; or ``moves`` of them do so
        one by one.  Single steps from the largest table back to it change nothing, so their number before the next other step is
        drawn at once (it is geometric).
        """
        if moves is None:
            self.tables, self._sizes = draw_tables(self.counts, discount, weight, random), None
            self.__dict__.pop("groups", None)
            return
        for k, (rows, held) in enumerate(self.groups):
            left = np.minimum(self.counts[rows], moves).astype(np.float64)
            while True:
                every = np.flatnonzero(left > 0)
                if not len(every):
                    break
                part, dish = held[every], rows[every]
                line = np.arange(len(every))
                count, tables = self.counts[dish], (part > 0).sum(axis=1)
                big = part.argmax(axis=1)
                size = part[line, big]
                others = np.where(size > 1, size - 1 - discount, 0.0)  # a table of one is gone when its customer leaves
                back = others / (count - 1 - discount * (tables - (size == 1)) + weight[dish])
                stay = size / count * back
                with np.errstate(divide="ignore"):
                    skipped = np.where(stay > 0, np.floor(np.log(1 - random.random(len(every))) / np.log(stay)), 0)
                left[every] -= skipped + 1
                on = np.flatnonzero(left[every] >= 0)
                if not len(on):
                    continue
                live, part, dish, big, size, back, count = every[on], part[on], dish[on], big[on], size[on], back[on], count[on]
                line = np.arange(len(on))
                # One customer leaves: of the largest table, for another one, or of any other table.
                away = size * (1 - back)
                from_big = random.random(len(on)) * (away + count - size) < away
                rest = part.copy()
                rest[line, big] = 0
                seat = random.random(len(on)) * (count - size)
                table = (np.cumsum(rest, axis=1) <= seat[:, None]).sum(axis=1)
                table = np.where(from_big, big, np.minimum(table, part.shape[1] - 1))
                part[line, table] -= 1
                # And sits down again.
                old = np.where(part > 0, part - discount, 0.0)
                old[line[from_big], big[from_big]] = 0.0
                steps = np.cumsum(old, axis=1)
                draw = random.random(len(on)) * (steps[:, -1] + weight[dish]) - weight[dish]
                fresh = draw < 0
                if (part[fresh] > 0).all(axis=1).any():  # no empty table is left in the matrix
                    held = np.pad(held, ((0, 0), (0, held.shape[1])))
                    part = np.pad(part, ((0, 0), (0, part.shape[1])))
                chosen = np.where(fresh, (part == 0).argmax(axis=1), np.minimum((steps <= draw[:, None]).sum(axis=1), steps.shape[1] - 1))
                late = ~fresh & (part[line, chosen] == 0)  # rounding at the last table
                chosen[late] = part[late].argmax(axis=1)
                part[line, chosen] += 1
                held[live] = part
                self.tables[dish] = (part > 0).sum(axis=1)
            self.groups[k] = (rows, held)


def _expected_tables(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A start near the mean: tables opened by a constant ``weight`` among growing customers."""
    return np.clip(np.rint(weight * np.log1p(counts / weight)), 1, counts).astype(np.int64)


def _by_word(corpus: Corpus, bucket: int, ids: np.ndarray, values: list[np.ndarray], kind: str) -> dict[int, list[bytes]]:
    """Ascending word numbers with values, dealt by the chunk of the word."""
    chunk = corpus.chunk_of(ids)
    return {c: [C.pack_sorted(ids[at]), *(C.pack(v[at].astype(kind)) for v in values)] for c, at in C.place(chunk).items()}


def _gather(corpus: Corpus, bucket: int, u: np.ndarray, w: np.ndarray, by: list[np.ndarray]) -> list[dict]:
    """Sums over the pairs ``u, w`` for each word as a dish and as a context, one letter per chunk of words."""
    empty = [C.pack_sorted(np.zeros(0, np.int64)), *(C.pack(np.zeros(0, "<i8")) for _ in by)]
    sides = []
    for ids in (w, u):
        found, place = np.unique(ids, return_inverse=True)
        sides.append(_by_word(corpus, bucket, found, [np.bincount(place, b, len(found)) for b in by], "<i8"))
    return [_letter(bucket, c, *sides[0].get(c, empty), *sides[1].get(c, empty)) for c in sorted(set(sides[0]) | set(sides[1]))]


def _open(corpus: Corpus):
    """Pairs of a chunk with their training counts, and which of them each block asks for; one table per dish to begin with."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, letters = key[0].as_py(), _bodies(table)
        asked = [C.unpack_sorted(body[0]) for _, body in letters]
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(place, np.concatenate([C.unpack(body[1], "<i4") for _, body in letters]), len(keys)).astype(np.int64)
        u, w = np.divmod(keys, corpus.words)
        served, more = counts > 0, counts > 1
        rows = [_letter(bucket, _STATE, C.pack_sorted(keys[more]), C.pack(counts.astype("<i8")), sums=((counts == 1).sum(), (counts == 2).sum()))]
        at = 0
        for (block, _), own in zip(letters, asked):
            rows.append(_letter(bucket, -2 - block, C.pack_sorted(place[at : at + len(own)])))
            at += len(own)
        alone = (counts[served] == 1).astype(np.int64)
        rows += _gather(corpus, bucket, u[served], w[served], [np.ones(served.sum(), np.int64), alone])
        return _letters(rows)

    return run


def _parent(corpus: Corpus, discount: float, tables: float, round_: int):
    """One chunk of the parent's dishes: its customers are the tables of all restaurants; answers what each bucket asks.

    Kept: ``T - d t`` of each word as a dish, its tables as a context, and both from the pairs served once.
    """

    def run(key: tuple, letters: pa.Table, kept: pa.Table | None) -> pa.Table:
        chunk, bodies = key[0].as_py(), _bodies(letters)
        first, size = int(corpus.firsts[chunk]), int(corpus.firsts[chunk + 1] - corpus.firsts[chunk])
        customers, opened = np.zeros(size, np.int64), np.zeros(size, np.int64)
        single = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
        if kept is not None and kept.num_rows:
            body = list(kept.column("body")[0].values)
            single = [C.unpack(body[2], "<i8"), C.unpack(body[3], "<i8")]
            customers, opened = single[0].copy(), single[1].copy()
        asks = []
        for bucket, body in bodies:
            half = len(body) // 2
            dish, context = (C.unpack_sorted(body[k]) - first for k in (0, half))
            for total, ids, values in ((customers, dish, body[1]), (opened, context, body[half + 1])):
                total[ids] += C.unpack(values, "<i8")
            if half == 3:  # the first letters count pairs served once apart; the others are asked for from now on
                alone = [C.unpack(body[2], "<i8"), C.unpack(body[5], "<i8")]
                single[0][dish] += alone[0]
                single[1][context] += alone[1]
                dish, context = dish[C.unpack(body[1], "<i8") > alone[0]], context[C.unpack(body[4], "<i8") > alone[1]]
            asks.append((bucket, dish, context))
        random = np.random.default_rng([corpus.settings.seed, round_, chunk, 1])
        weight = (corpus.settings.strength + discount * tables) / (corpus.words + 1)
        many = np.flatnonzero(customers > 1)
        seats = Seating(customers[many], _expected_tables(customers[many], np.full(len(many), weight)))
        for _ in range(corpus.settings.sweeps if corpus.settings.moves else 1):  # the weight stays, and all at once depend on it alone
            seats.sweep(discount, np.full(len(many), weight), corpus.settings.moves, random)
        at_table = np.minimum(customers, 1)
        at_table[many] = seats.tables
        mass = customers - discount * at_table
        rows = [_letter(chunk, _STATE, C.pack(mass), C.pack(opened), C.pack(single[0]), C.pack(single[1]), sums=(at_table.sum(), customers.sum(), (customers == 1).sum(), (customers == 2).sum()))]
        rows += [_letter(chunk, bucket, C.pack(mass[dish]), C.pack(opened[context])) for bucket, dish, context in asks]
        return _letters(rows)

    return run


@dataclass(frozen=True)
class Parent:
    """Sums over all dishes of the parent in one round."""

    discount: float
    strength: float
    tables: float
    customers: float
    words: int

    def probability(self, mass: np.ndarray | float) -> np.ndarray | float:
        """Of a word whose customers weigh ``mass`` there; 0 for an unknown one."""
        return (mass + (self.strength + self.discount * self.tables) / (self.words + 1)) / (self.strength + self.customers)


def _seat(corpus: Corpus, discount: float, parent: Parent, round_: int):
    """Sweeps over the dishes of one chunk that are served more than once; keeps tables and the sum of all samples' tables."""

    def run(key: tuple, kept: pa.Table, letters: pa.Table) -> pa.Table:
        if not kept.num_rows:
            return _letters([])
        bucket, settings = key[0].as_py(), corpus.settings
        body = {k: list(b.values) for k, b in zip(kept.column("receiver").to_pylist(), kept.column("body"))}
        keys = C.unpack_sorted(body[_STATE][0])
        counts = C.unpack(body[_STATE][1], "<i8")
        counts = counts[counts > 1]
        u, w = np.divmod(keys, corpus.words)
        (dishes, dish), (contexts, context) = (np.unique(x, return_inverse=True) for x in (w, u))
        mass, opened = np.zeros(len(dishes)), np.zeros(len(contexts), np.int64)
        where = C.place(corpus.chunk_of(dishes)), C.place(corpus.chunk_of(contexts))
        for chunk, answer in _bodies(letters):
            for out, at, values in ((mass, where[0], C.unpack(answer[0], "<f8")), (opened, where[1], C.unpack(answer[1], "<i8"))):
                if chunk in at:
                    out[at[chunk]] = values
        base = parent.probability(mass)[dish]
        weight = lambda: (settings.strength + discount * np.maximum(opened, 1)[context]) * base
        if _SEATS in body:
            old = C.unpack(body[_SEATS][0], "<i8")
            sizes = C.unpack(body[_SEATS][1], "<i4")
            seats, total = Seating(counts, old, sizes if settings.moves else None), C.unpack(body[_SEATS][2], "<i8")
        else:
            seats, total = Seating(counts, _expected_tables(counts, weight())), np.zeros(len(counts), np.int64)
            old = np.ones(len(counts), np.int64)
        random = np.random.default_rng([settings.seed, round_, bucket])
        for _ in range(settings.sweeps):
            opened = opened + np.bincount(context, seats.tables - old, len(contexts)).astype(np.int64)
            old = seats.tables.copy()
            seats.sweep(discount, weight(), settings.moves, random)
        if round_ > settings.burn:
            total = total + seats.tables
        sizes = seats.sizes() if settings.moves else np.zeros(0, np.int32)  # single steps go on from them
        rows = [_letter(bucket, _SEATS, C.pack(seats.tables.astype("<i8")), C.pack(sizes), C.pack(total.astype("<i8")))]
        return _letters(rows + _gather(corpus, bucket, u, w, [seats.tables]))

    return run


# Scores

def _tell_pairs(discount: float, rounds: int):
    """To each block, the weight ``c - d t`` of the pairs it asked for, ``t`` averaged over the samples."""

    def run(key: tuple, kept: pa.Table, seats: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        state = next(list(b.values) for r, b in zip(kept.column("receiver").to_pylist(), kept.column("body")) if r == _STATE)
        counts = C.unpack(state[1], "<i8")
        weight = counts - discount * np.minimum(counts, 1)
        if seats.num_rows:
            weight[counts > 1] = counts[counts > 1] - discount * C.unpack(list(seats.column("body")[0].values)[2], "<i8") / rounds
        return _letters([
            _letter(bucket, -2 - r, C.pack(weight[C.unpack_sorted(b.values[0])]))
            for r, b in zip(kept.column("receiver").to_pylist(), kept.column("body")) if r != _STATE])

    return run


def _tell_words():
    """To each block, for each sample the parent's mass and the tables of the block's words."""

    def run(key: tuple, asked: pa.Table, kept: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        samples = sorted((r, list(b.values)) for r, b in zip(kept.column("round").to_pylist(), kept.column("body")))
        values = [(C.unpack(body[0], "<f8"), C.unpack(body[1], "<i8")) for _, body in samples]
        rows = []
        for block, body in zip(asked.column("receiver").to_pylist(), asked.column("body")):
            number = C.unpack(body.values[0], "<i4")
            known = number >= 0
            out = []
            for mass, opened in values:
                for of, kind in ((mass, "<f8"), (opened, "<i8")):
                    found = np.zeros(len(number), kind)
                    found[known] = of[number[known]]
                    out.append(C.pack(found))
            rows.append(_letter(chunk, block, *out))
        return _letters(rows)

    return run


def _text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values; every text has a token at least."""
    return np.add.reduceat(values, offsets[:-1])


def _score(corpus: Corpus, discount: float, parents: list[Parent]):
    def run(blocks: pa.Table, letters: pa.Table) -> pa.Table:
        kinds: dict[str, list] = {"vocabulary": [], "words": [], "pairs": []}
        for kind, letter in zip(letters.column("kind").to_pylist(), _bodies(letters)):
            kinds[kind].append(letter)
        block = Block(blocks, kinds["vocabulary"], corpus)
        keys, _, owner, place = block.pairs(corpus)
        weight = np.zeros(len(keys) + 1)  # the last place is that of pairs with an untrained word
        at = C.place(owner)
        for bucket, body in kinds["pairs"]:
            weight[at[bucket]] = C.unpack(body[0], "<f8")
        del keys, owner, at
        before, strength = block.contexts(), corpus.settings.strength
        samples = []
        for k, parent in enumerate(parents):
            mass, opened = np.zeros(len(block.ids)), np.zeros(len(block.ids))
            for chunk, body in kinds["words"] if corpus.words else ():
                mass[block.where[chunk]], opened[block.where[chunk]] = C.unpack(body[2 * k], "<f8"), C.unpack(body[2 * k + 1], "<i8")
            samples.append((strength + discount * opened, parent.probability(mass)))
        kinds.clear()
        logs = np.empty(len(block.codes))
        for start in range(0, len(logs), _SLICE):
            part = slice(start, start + _SLICE)
            context, word = before[part], block.codes[part]
            smooth = sum(lead[context] * base[word] for lead, base in samples) / len(samples)
            logs[part] = np.log10((weight[place[part]] + smooth) / (strength + block.counts[context]))
        offsets = block.offsets
        known = block.counts > 0
        base = np.log10(block.counts + 1) - math.log10(corpus.tokens + corpus.words + 1)
        scores = _text_sums(logs, offsets)
        del logs, before, place
        W.release()
        return pa.table({
            "id": block.rows["ids"].values, "held_out": pc.invert(block.rows["train"].values), "n_tokens": pa.array(np.diff(offsets)),
            "n_known": pa.array(C.sums(known[block.codes].astype(np.int64), offsets)),
            "train_tokens": pa.array(np.full(len(offsets) - 1, corpus.tokens, np.int64)),
            "base_score": pa.array(_text_sums(base[block.codes], offsets)), "score": pa.array(scores),
        })

    return run


def _discount(once: float, twice: float) -> float:
    """The usual estimate from what is met once and twice."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def _total(letters: DataFrame, size: int) -> list[float]:
    """Sums over what tasks keep: a row of numbers reaches the driver."""
    row = letters.where(F.col("receiver") == _STATE).agg(*(F.sum(F.col("sums")[k]) for k in range(size))).first()
    return [x or 0.0 for x in row]


def score(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """One row per row of ``df``: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows where ``train`` holds (by default ``training_rows``) and scores all.  Tokens are the words between white space, A-Z
    lower-cased, and one end token; the model is of word pairs, the first word follows an end token.  ``score`` is the log10
    probability of the text, averaged over the samples token by token; ``base_score`` that of smoothed word counts.

    Null and empty texts are the end token alone.  Rows that repeat are rows of their own, each counted; without training rows
    every token is unknown.  An empty table gives no row.  Other columns are not read.

    A block of documents sends its distinct words and pairs, dealt by chunk, and is answered with what they weigh; a word or
    pair moves once per block, and nothing of the corpus is broadcast or collected but a few sums per round and the
    vocabulary size of each chunk.
    """
    kind = dict(df.dtypes)[id_col]
    parts = settings.chunks or C.chunks_for(df, text_col, settings.chunk_bytes)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (training_rows(id_col) if train is None else train).alias("train"))
    blocks = stage(docs.mapInArrow(
        W.lean(_describe(settings, parts)),
        f"block long, ids array<{kind}>, train array<boolean>, offsets binary, codes binary, owner binary, {C.REQUEST}"), "blocks")
    vocabulary = stage(blocks.select("block", F.inline("requests")).groupBy("chunk").applyInArrow(_vocabulary, LETTER), "vocabulary")
    sizes = np.zeros(parts, np.int64)
    tokens = 0
    for row in vocabulary.where(F.col("receiver") == _STATE).select("sender", "sums").collect():
        sizes[row["sender"]] = int(row["sums"][0])
        tokens += int(row["sums"][1])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    corpus = Corpus(int(firsts[-1]), tokens, firsts, parts, settings)

    texts = blocks.drop("requests").groupBy("block")
    told = vocabulary.where("receiver >= 0")
    asked = texts.cogroup(told.groupBy("receiver")).applyInArrow(_ask(corpus), LETTER)
    opened = stage(asked.groupBy("receiver").applyInArrow(_open(corpus), LETTER), "pairs")
    discount = _discount(*_total(opened, 2))

    to = lambda letters: letters.where("receiver >= 0").groupBy("receiver")
    kept_by = lambda letters, mark: letters.where(F.col("receiver") == mark)
    first = _parent(corpus, 0.5, corpus.words, 0)
    above = stage(to(opened).applyInArrow(lambda key, letters: first(key, letters, None), LETTER), "parent")
    tables, customers, once, twice = _total(above, 4)
    upper = _discount(once, twice)
    parent = Parent(0.5, settings.strength, tables, customers, corpus.words)
    seats, samples, parents = None, None, []
    for r in range(1, settings.rounds + 1):
        kept = kept_by(opened, _STATE) if seats is None else kept_by(opened, _STATE).union(kept_by(seats, _SEATS))
        seats = stage(kept.groupBy("sender").cogroup(to(above)).applyInArrow(_seat(corpus, discount, parent, r), LETTER), "seats")
        above = stage(to(seats).cogroup(kept_by(above, _STATE).groupBy("sender")).applyInArrow(_parent(corpus, upper, parent.tables, r), LETTER), "parent")
        tables, customers, *_ = _total(above, 4)
        parent = Parent(upper, settings.strength, tables, customers, corpus.words)
        if r > settings.burn:
            parents.append(parent)
            sample = kept_by(above, _STATE).withColumn("round", F.lit(r))
            samples = sample if samples is None else samples.union(sample)

    pairs = opened.where("receiver < 0").groupBy("sender").cogroup(kept_by(seats, _SEATS).groupBy("sender")).applyInArrow(
        _tell_pairs(discount, len(parents)), LETTER)
    words = told.groupBy("sender").cogroup(samples.groupBy("sender")).applyInArrow(_tell_words(), LETTER)
    marked = [letters.withColumn("kind", F.lit(kind)) for kind, letters in (("vocabulary", told), ("words", words), ("pairs", pairs))]
    return texts.cogroup(marked[0].union(marked[1]).union(marked[2]).groupBy("receiver")).applyInArrow(
        _score(corpus, discount, parents),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """``held_out, texts, n_tokens, perplexity, base_perplexity`` of the rows that ``score`` returns."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(
        F.count("*").alias("texts"), F.sum("n_tokens").alias("n_tokens"), each("score").alias("perplexity"), each("base_score").alias("base_perplexity"))
