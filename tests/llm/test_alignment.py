"""Cross-tokenizer alignment against a plain walk over the tokens of whole texts."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import DATA, documents, nothing, odd  # noqa: F401 - fixtures

from seriesmill.llm import align, csr

ODD = [
    "a  b", "  x\n\n y\t z ", "\n", "\n\nA\n\nB\n C", "é à ï\nü", "x  y  z", "▁ a ▁b", "<|endoftext|> <s> <unk> <0x41>", "日本 語\nテ スト", "🙂 🙂\n🙂",
    "\x00 a\x00b", "a\r\nb ;\r", "don't 's 's", "", None, " ", "    ", "a ", "a\n", "  a b", "\u0085 b a\u0085 c", "x﻿ y", "×÷ × a÷ b",
]


@pytest.fixture(scope="module")
def models():
    return align.ByteTokens(None), align.PieceTokens(None)


def tokens(models, text):
    """Ids and byte ends on both sides, or None."""
    found = []
    for model, ids in ((models[0], models[0].model.encode(" " + text, add_special_tokens=False).ids), (models[1], models[1].model.encode(text))):
        parts = [model.bytes[k].as_py() for k in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        found += [ids, np.cumsum([len(p) for p in parts]).tolist()]
    return found


def walk(models, docs):
    per, total = {}, collections.Counter()
    for name, text in docs:
        found = tokens(models, text) if text else None
        if not found:
            per[name] = None
            continue
        a, a_end, b, b_end = found
        links, groups, x, y = [], [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            i, j = a_end.index(end), b_end.index(end)
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        total.update(links)
        per[name] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = collections.Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return {
        name: (0, 0, 0, 0, 0, 0, "") if v is None else
        (v[0], v[1], v[2], len(v[3]), sum(total[link] == best[link[1]] for link in v[3]), sum(total[link] for link in v[3]), v[4])
        for name, v in per.items()}


@pytest.mark.parametrize("block", [30_000, 8 << 20])
def test_alignment_against_a_walk(spark, models, documents, block):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(80).collect()] + [(10_000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = align.align(df, align.Settings(block_bytes=block, chunks=5)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == walk(models, docs)


def test_edges(odd, nothing):
    found = align.align(odd).collect()
    assert len(found) == odd.count() and sum(r.n_a == 0 and r.groups_sha256 == "" for r in found) == 3  # two nulls and an empty text
    assert align.align(nothing).count() == 0 and align.token_links(nothing).count() == 0


def test_stretches_are_encoded_as_in_the_text(models):
    aligner = align.Aligner(align.Settings())
    assert aligner.cuts
    for text in ODD:
        codes, offsets, stretches = align.split_units(pa.array([text], pa.string()))
        parts = [stretches[int(c)].as_py().decode() for c in codes]
        assert "".join(parts) == " " + (text or "")
        assert sum(models[0].encode(parts), []) == models[0].encode([" " + (text or "")])[0]


def test_links_of_a_text(spark, models):
    text = "Unbelievable  things, überall!"
    row = align.token_links(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, a_end, b, b_end = tokens(models, text)
    start = lambda ends, k: ends[k - 1] if k else 0
    shared = {(i, j): min(a_end[i], b_end[j]) - max(start(a_end, i), start(b_end, j)) for i in range(len(a)) for j in range(len(b))}
    assert (row.a, row.b) == (a, b) and {(x.a, x.b): x.bytes for x in row.overlaps} == {k: n for k, n in shared.items() if n > 0}
    common = sorted(set(a_end) & set(b_end))
    group = lambda end: next(k for k, c in enumerate(common) if end <= c)
    assert {(x.a, x.b) for x in row.shared_groups} == {(i, j) for i in range(len(a)) for j in range(len(b)) if group(a_end[i]) == group(b_end[j])}


def test_product_of_sparse_matrices():
    rng = np.random.default_rng(4)
    for shape in ((5, 7, 4), (1, 1, 1), (6, 3, 0), (0, 4, 5)):
        x, y = rng.integers(0, 3, shape[:2]), rng.integers(0, 3, shape[1:])
        as_csr = lambda m: csr.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]), np.nonzero(m)[1], m[np.nonzero(m)], m.shape[1])
        dense = lambda m: [[dict(zip(m.indices[a:b].tolist(), m.data[a:b].tolist())).get(c, 0) for c in range(m.columns)] for a, b in zip(m.indptr[:-1], m.indptr[1:])]
        assert dense(as_csr(x) @ as_csr(y)) == (x @ y).tolist()
        assert dense(as_csr(x).T) == x.T.tolist()
