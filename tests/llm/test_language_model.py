"""Hierarchical Pitman-Yor model: counts and base score exactly, the sampler against enumeration, the model against its own sums."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from edge_rows import documents, nothing, odd  # noqa: F401 - fixtures
from pyspark.sql import functions as F

from seriesmill.llm import chunks as C
from seriesmill.llm import pitman_yor as P


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [""]


def trained(name):
    return name is not None and zlib.crc32(str(name).encode()) % 7 != 2


@pytest.mark.parametrize("settings", [P.Settings(block_bytes=20_000, chunks=3), P.Settings(chunks=1, shard_tokens=50), P.Settings(block_bytes=20_000, chunks=7, shard_tokens=100)])
def test_counts_and_base_score(spark, documents, settings):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(None, "a b"), (5001, None), (5002, ""), (5002, "The THE the")]
    counts = collections.Counter(w for i, t in docs if trained(i) for w in tokens(t))
    total, words = sum(counts.values()), len(counts)
    rows = P.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), settings).collect()
    expected = collections.Counter()
    for i, t in docs:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + words + 1)) for w in own)
        expected[i, not trained(i), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)] += 1
    assert collections.Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
    assert all(r.score < 0 for r in rows)
    summary = {r.held_out: r for r in P.perplexity(spark.createDataFrame(rows)).collect()}
    assert summary[True].perplexity < 0.7 * summary[True].base_perplexity and summary[False].perplexity < summary[True].perplexity


def test_every_context_sums_to_one(spark):
    """Scores of one-word texts and their continuations give back all probabilities of a small vocabulary."""
    train = [(k, t) for k, t in enumerate(["a b c", "a b", "b b a", "c", "a c c c b", "a b c d", "d a b"] * 3)]
    vocabulary = ["a", "b", "c", "d", "zzz"]  # the last one is unknown
    # Texts u w1 .. wk differ by one more word: their ratios are products of pair probabilities.
    texts = [" ".join(x) for n in (0, 1, 2) for x in itertools.product(vocabulary, repeat=n)]
    rows = train + [(1000 + k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.id: 10 ** r.score for r in P.score(df, P.Settings(chunks=2), train=F.col("doc_id") < 1000).collect() if r.id >= 1000}
    p = {t: scores[1000 + k] for k, t in enumerate(texts)}
    # p(u) = P(u|end) P(end|u) and p(u w) = P(u|end) P(w|u) P(end|w): with e(w) = P(end|w), sum_w P(w|u) + e(u) = 1 for all u.
    # p(u w) e(u) / (p(u) e(w)) = P(w|u); solve for e by iteration from the end token's own context.
    e = {w: 0.3 for w in vocabulary}
    for _ in range(4000):
        e = {u: 0.5 * e[u] + 0.5 * (1 / (1 + sum(p[f"{u} {w}"] / (p[u] * e[w]) for w in vocabulary))) for u in vocabulary}
    first = {w: p[w] / e[w] for w in vocabulary}
    assert abs(sum(first.values()) + p[""] - 1) < 1e-6
    assert all(0 < e[u] < 1 for u in vocabulary)


def test_gibbs_steps_reach_the_seating_distribution():
    """Three customers of one dish, a fixed weight of new tables: the tables' distribution by enumeration."""
    d, a, n = 0.6, 0.8, 40_000
    weights = {1: (1 - d) * (2 - d) * a, 2: 3 * (1 - d) * a * a, 3: a**3}  # one, two (three ways), three tables
    seats = P.Seating(np.full(n, 3), np.ones(n, np.int64))
    random = np.random.default_rng(2)
    for _ in range(12):
        seats.sweep(d, np.full(n, a), 6, random)
    shares = np.bincount(seats.tables, minlength=4)[1:] / n
    assert np.allclose(shares, np.array(list(weights.values())) / sum(weights.values()), atol=0.012)
    sizes = seats.sizes()
    ends = np.cumsum(seats.tables)
    assert (sizes > 0).all() and (C.sums(sizes.astype(np.int64), np.concatenate([[0], ends])) == 3).all()


def test_seating_keeps_customers_whatever_the_room():
    counts = np.array([2, 3, 9, 70, 5000])
    seats = P.Seating(counts, np.array([1, 3, 2, 40, 3]))
    random = np.random.default_rng(3)
    for _ in range(30):
        seats.sweep(0.5, np.array([5.0, 0.1, 50.0, 1000.0, 4000.0]), 8, random)
        again = P.Seating(counts, seats.tables, seats.sizes())
        assert again.sizes().sum() == seats.sizes().sum() == counts.sum() and (seats.tables <= counts).all() and (seats.tables >= 1).all()


def test_edges(odd, nothing):
    rows = P.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert sum(r.n_tokens == 1 for r in rows) == 4  # two nulls, an empty and a blank text
    assert P.score(nothing).count() == 0
    untrained = P.score(odd, train=F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.base_score == 0 and abs(r.score) < 1e-9 for r in untrained)


def test_a_sweep_seats_every_customer():
    """Large dishes from one table only: the sweeps bring the mean number of tables to that of the exact distribution."""
    d, a, c, n = 0.6, 2.0, 60, 4000
    stirling = np.zeros(c + 1)  # of partitions of so many customers into tables, by the tables
    stirling[1] = 1.0
    for customers in range(1, c):
        k = np.arange(c + 1)
        stirling = (customers - d * k) * stirling + np.concatenate([[0.0], stirling[:-1]])
    shares = stirling * a ** np.arange(c + 1)
    mean = (shares * np.arange(c + 1)).sum() / shares.sum()
    seats = P.Seating(np.full(n, c), np.ones(n, np.int64))
    random = np.random.default_rng(4)
    for _ in range(80):
        seats.sweep(d, np.full(n, a), P.Settings().moves, random)
    assert abs(seats.tables.mean() - mean) < 0.1


def test_tables_of_large_dishes_by_contour():
    """The shares of table numbers, by the recursion over customers and by the contour integral, over weights from tiny to large."""
    for d in (0.05, 0.5, 0.95):
        rows = P._log_stirling(d, np.array([1100, 2500]))
        for count, row in rows.items():
            for weight in (1e-6, 0.5, 30.0, 1000.0, 4000.0, 1e6):
                exact = row + np.log(weight) * np.arange(1, count + 1)
                exact = np.exp(exact - exact.max())
                found = np.zeros(count)
                t, shares = P.table_shares(count, weight, d)
                found[t - 1] = shares
                assert np.abs(found - exact / exact.sum()).sum() < 1e-6, (d, count, weight)


def test_a_sweep_costs_the_same_for_a_dish_of_many_customers():
    """A dish of fifty million customers was seated step by step in one task; its tables are drawn as those of a small one."""
    d, a, n = 0.6, 40.0, 50_000_000
    drawn = P.draw_tables(np.full(200, n), d, np.full(200, a), np.random.default_rng(5))
    # Few tables for so many customers: their number but one is nearly that of a Poisson variable.
    assert abs(drawn.mean() - 1 - a / d) < 3
    seats = P.Seating(np.array([n, 2, 700]), np.array([1, 1, 1]))
    seats.sweep(d, np.array([a, 0.5, 3.0]), None, np.random.default_rng(6))
    assert (seats.tables >= 1).all() and (seats.tables <= seats.counts).all() and seats.sizes().sum() == seats.counts.sum()
