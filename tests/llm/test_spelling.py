"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from edge_rows import documents, nothing, odd  # noqa: F401 - fixtures
from pyspark.sql import functions as F

from seriesmill.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    form, seen = {}, {}
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    for w, n in counts.items():
        found = [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w], seen[w] = best if best and counts[best] >= 2 * n else None, len(found)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, seen[w], counts.get(form[w])) for w, n in counts.items()}


def shaped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abé÷"])
def test_variants_against_all_pairs(spark, alphabet):
    random.seed(len(alphabet))
    words = {"".join(random.choice(alphabet) for _ in range(random.randint(1, 9))) for _ in range(260)} | {"a", "aa", "aaa", "日本語", "日本", "x" * 2000, "x" * 1999}
    counts = {w: random.choice([1, 2, 3, 5, 9, 20, 60, 500]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the trie spans several partitions
    try:
        assert shaped(spelling.variants(df)) == brute(counts)
        walked = spelling.trie(df, F.col("word"))
        numbers = {}
        for r in walked.collect():
            for k, number in enumerate(r.path):
                assert numbers.setdefault(r.word[: k + 1], number) == number
        assert len(set(numbers.values())) == len(numbers) and min(numbers.values()) >= 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_counts_of_words(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    docs += [(None, "aaaab Aaaab AAAAB ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ Àéîõü word-word wor'ds ××÷÷x ××÷÷x ××÷÷x"), (1, None), (2, "")]
    expected = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            expected[word] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == expected
    assert shaped(spelling.spelling_variants(df)) == brute(expected)


def test_edges(odd, nothing):
    assert spelling.spelling_variants(nothing).count() == 0
    assert {r.word for r in spelling.spelling_variants(odd, spelling.Settings(min_length=1, min_count=2, noise=0)).collect()} >= {"the", "w", "word"}
