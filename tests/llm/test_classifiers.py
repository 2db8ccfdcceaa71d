"""The classifiers against slow learners over one feature at a time."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from seriesmill.llm import langid, toxicity
from seriesmill.llm import words as W

TEXTS = [
    "You are a worthless fool, really a worthless one.", "The weather is fine today and the tea is warm.", "worthless people make me sick!", "", None,
    "A fine day; the fool went home.", "Überaus dumm, wirklich dumm bist du.", "tea tea tea", "sick worthless fool", "the day was fine",
] * 4
MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & MASK
    return x ^ (x >> 29)


def hashed(word, seed=0):
    return xxhash.xxh3_64_intdigest(word.encode(), seed)


def key(x):
    return x >> (64 - toxicity.HASH_BITS)


def slow_features(text):
    found = set()
    own = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    for word in own:
        found.add(key(mix(hashed(word))))
        for size in toxicity.STEMS:
            if len(word) > size:
                found.add(key(mix(hashed(word[:size], size))))
    for steps in toxicity.STEPS:
        for k in range(len(own) - max(steps)):
            total = mix((hashed(own[k]) + len(steps)) & MASK)
            for step in steps:
                total = mix((total * 31 + hashed(own[k + step]) + step) & MASK)
            found.add(key(total))
    return sorted(found)


def test_toxicity_features_one_by_one():
    owners, keys = toxicity.features(pa.array(TEXTS, pa.string()))
    assert [keys[owners == k].tolist() for k in range(len(TEXTS))] == [slow_features(t) for t in TEXTS]


def test_ftrl_coordinate_by_coordinate():
    settings = toxicity.Settings(l1=0.5, min_rows=2, epochs=3)
    labels = [int("worthless" in (t or "") or "dumm" in (t or "")) for t in TEXTS]
    rows = [(y, np.array(slow_features(t), np.int32)) for y, t in zip(labels, TEXTS)]
    found = toxicity.ftrl(rows, settings)
    counts = collections.Counter(int(k) for _, keys in rows for k in keys)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        bound = 0.0 if f == "bias" else settings.l1
        if abs(z[f]) <= bound:
            return 0.0
        return (math.copysign(bound, z[f]) - z[f]) / ((settings.beta + math.sqrt(n[f])) / settings.alpha + settings.l2)

    for epoch in range(settings.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            label, keys = rows[k]
            own = [int(f) for f in keys if counts[int(f)] >= settings.min_rows] + ["bias"]
            w = {f: weight(f) for f in own}
            slope = 1 / (1 + math.exp(-sum(w.values()))) - label
            slope *= settings.positive_weight if label else 1
            for f in own:
                sigma = (math.sqrt(n[f] + slope * slope) - math.sqrt(n[f])) / settings.alpha
                z[f] += slope - sigma * w[f]
                n[f] += slope * slope
    expected = {f: weight(f) for f in list(z) if f != "bias" and weight(f)}
    assert dict(zip(found.keys.tolist(), found.values.tolist())) == pytest.approx(expected) and found.bias == pytest.approx(weight("bias"))
    scores = toxicity.score_texts(pa.array(TEXTS, pa.string()), found)
    for text, score in zip(TEXTS, scores):
        total = found.bias + sum(expected.get(f, 0.0) for f in slow_features(text))
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert (scores[np.array(labels) == 1].min() > 0.5) and (scores[np.array(labels) == 0].max() < 0.5)


def slow_grams(text, buckets, longest):
    for word in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()):
        points = [ord(c) for c in f" {word} "]
        for at in range(len(points)):
            total = 0
            for size in range(1, longest + 1):
                if at + size <= len(points):
                    total = mix((total * 31 + points[at + size - 1] + size) & MASK)
                    yield total % buckets


def test_naive_bayes_gram_by_gram(spark):
    texts = ["the cat sat on the mat", "the dog and the hat", "der hund und die katze", "die katze sass dort", "le chat est là", "und", "", None, "123 !!", "Là-bas, le chien"]
    langs = ["en", "en", "de", "de", "fr", "de", None, "en", "fr", "fr"]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs))], "id long, text string, label string")
    settings = langid.Settings(buckets=512, longest=3)
    model = langid.fit(df.select("id", "label"), df.select("id", "text"), settings)
    counts = {lang: collections.Counter() for lang in ("de", "en", "fr")}
    documents = collections.Counter()
    for text, lang in zip(texts, langs):
        if lang and text is not None:
            counts[lang].update(slow_grams(text, 512, 3))
            documents[lang] += 1
    total = sum(documents.values())
    found, scores = langid.predict_texts(pa.array(texts + ["the hund", "chat"], pa.string()), model)
    for text, lang, score in zip(texts + ["the hund", "chat"], found, scores):
        grams = list(slow_grams(text, 512, 3))
        logs = {}
        for own in counts:
            size = sum(counts[own].values()) + 0.5 * 512
            logs[own] = math.log((documents[own] + 1) / (total + 3)) + sum(math.log((counts[own][g] + 0.5) / size) for g in grams)
        best = max(sorted(logs), key=logs.get)
        if not re.search("[^\\W\\d_]", text or ""):
            assert (lang, score) == ("und", 0)
            continue
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert lang == best and score == pytest.approx(share, rel=1e-4)


def test_features_of_a_batch_are_made_in_small_blocks():
    """Word pairs take some fifty times their text, and two workers stand beside an executor's heap: no more than a megabyte of text at a time."""
    texts = pa.array([f"word{k} other{k % 7} " * 6000 for k in range(30)])
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 30, pa.int32()), texts], ["label", "text"])
    parts = list(toxicity._feature_rows(iter([batch])))
    assert sum(p.num_rows for p in parts) == 30
    assert all(p.num_rows * len(texts[-1].as_py()) <= 1.1 * (1 << 20) for p in parts)
