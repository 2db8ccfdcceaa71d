"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from edge_rows import DATA, documents, nothing, odd  # noqa: F401 - fixtures
from pyspark.sql import functions as F

import corpus_pipeline
from seriesmill.llm import circulant_minhash, decontaminate, langid, ledger, line_runs, packing, tagpath, toxicity, wavelet, weak_quality

LABELS = "id long, label int"
ITEMS = [("a", "the lazy dog near the old river"), (None, "same id"), ("c", None), ("d", "")]
ITEM_SCHEMA = "item string, text string"


def ids(df):
    return df.select(F.col("doc_id").alias("id"), "text")


def test_toxicity(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (5, 0), (None, 1), (7, 0), (9, None)], LABELS)
    weights = toxicity.fit(labels, ids(odd))
    found = odd.withColumn("score", toxicity.score(weights)).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not r.text}) == 1  # null and empty: the bias
    for empty in (toxicity.fit(labels.limit(0), ids(odd)), toxicity.fit(labels, ids(nothing))):
        assert not len(empty.keys) and {round(r.score, 9) for r in odd.withColumn("score", toxicity.score(empty)).collect()} == {0.25}
    assert nothing.withColumn("score", toxicity.score(weights)).count() == 0


def test_quality(odd, nothing):
    _, patterns, scorer = weak_quality.fit(ids(odd))
    assert patterns["rows"].sum() == odd.count()
    found = weak_quality.with_votes(odd.withColumn("score", weak_quality.score(scorer))).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 and len(r.votes) == len(weak_quality.HEURISTICS) for r in found)
    _, patterns, scorer = weak_quality.fit(ids(nothing))
    assert patterns.empty and {r.s for r in odd.select(weak_quality.score(scorer).alias("s")).collect()} == {0.5}


def test_language(spark, odd, nothing):
    labels = spark.createDataFrame([(1, "en"), (7, "xx"), (9, "de"), (None, "fr"), (5, None)], "id long, label string")
    model = langid.fit(labels, ids(odd))
    assert model.languages == ("de", "en", "xx")
    found = odd.select("text", langid.predict(model).alias("p")).collect()
    for row in found:
        lettered = any(c.isalpha() for c in row.text or "")
        assert (row.p.lang_pred == "und") == (not lettered) and 0 <= row.p.score <= 1
    unknown = langid.fit(labels, ids(nothing))
    assert {r.p.lang_pred for r in odd.select(langid.predict(unknown).alias("p")).collect()} == {"und"}


def test_near_duplicates(odd, nothing):
    found = [(r.id, r.n_shingles, r.component_id, r.kept) for r in circulant_minhash.near_duplicates(odd, circulant_minhash.Settings(shingle=2)).collect()]
    assert len(found) == odd.count()
    assert {(5, 1, 5, True), (6, 1, 5, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)} <= set(found)
    assert sum(r[0] == 7 and r[2] == 7 for r in found) == 3
    assert circulant_minhash.near_duplicates(nothing).count() == 0


def test_decontamination(spark, odd, nothing):
    items = spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    rows = decontaminate.contamination(odd, items)
    assert set(rows.columns) == set(odd.columns)
    found = {(r.doc_id, r.text): r.contamination for r in rows.collect()}
    one = next(v for (i, t), v in found.items() if i == 1)
    assert (one.n_words, one.n_hit, one.items, one.contaminated) == (17, 7, ["a"], True)
    text = next(t for i, t in found if i == 1)
    assert [text[s.start : s.end] for s in one.spans] == ["the lazy dog near the old river"]
    assert found[(7, "another text of the same id")].items == ["null"]
    assert found[(2, None)].n_words == found[(3, "")].n_words == 0 and not found[(8, "!!! ... ###")].contaminated
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r.contamination.n_hit for r in decontaminate.contamination(odd, items.limit(0)).collect())


def test_line_dedup(spark, odd, nothing):
    rows = line_runs.dedup_lines(odd)
    assert set(rows.columns) == set(odd.columns) and rows.count() == odd.count()
    assert {(r.doc_id, r.text, r.lines_deleted) for r in rows.collect()} == {(r.doc_id, r.text, 0) for r in odd.collect()}
    assert line_runs.dedup_lines(nothing).count() == 0


def test_packing(odd, nothing):
    found = packing.pack(odd).collect()
    starts = [r for r in found if r.piece == 0]
    assert len(starts) == odd.count() and sum(r.length == 1 and r.piece == 0 for r in found) == 4
    assert packing.pack(nothing).count() == 0


def test_ledger(odd, nothing):
    rows = ledger.ledger(ledger.measure(odd))
    found = {(r.doc_id, r.text): r for r in rows.collect()}
    for key in ((2, None), (3, ""), (4, " \t\n \x0b")):
        assert (found[key].n_words, found[key].word_chars, found[key].n_dup_lines) == (0, 0, 0) and found[key].bits == 1
    assert found[(8, "!!! ... ###")].n_symbols == 3
    assert found[next(k for k in found if k[0] == 7 and len(k[1]) > 100)].n_repeat_words == 60_000
    assert ledger.ledger(ledger.measure(nothing)).count() == 0 and ledger.ablations(ledger.ledger(ledger.measure(nothing)), "v2").count() == 0


def test_wavelet(odd, nothing):
    found = wavelet.round_trip(odd, wavelet.Settings(shard_tokens=50_000)).collect()
    assert len(found) == odd.count() and sum(r.n_tokens == 1 for r in found) == 4
    ordered = sorted(found, key=lambda r: r.start)
    at = 0
    for row in ordered:
        assert row.start == at
        at += row.n_tokens
    assert [r.id for r in ordered] == sorted((r.id for r in found), key=lambda i: (i is not None, i or 0))
    assert wavelet.round_trip(nothing).count() == 0


def test_pages(spark):
    pages = ["", None, "<", "<p", "text", "<p>" * 3000, "a" * 300_000, "<div>" * 5000 + "deep text, here", "<!-- x", "<script>x", "&am", "&#x110000;x"]
    df = spark.createDataFrame([(p, "y") for p in pages], "html string, text string")
    found = [r.text for r in df.select(tagpath.main_text().alias("text")).collect()]
    assert found[:3] == ["", "", "<"] and found[4] == "text" and found[6] == "a" * 300_000 and found[7] == "deep text, here"
    assert found[10] == "&am" and found[8] == found[9] == ""
    assert df.limit(0).select(tagpath.main_text()).count() == 0


def test_packing_stage(spark, nothing, documents):
    """The last stage packs what is left: nulls and empty texts are one end token, and a table without rows packs nothing."""
    name, run = corpus_pipeline.STAGES[4]
    few = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", None, "s", 4)], documents.schema)
    found = run(spark, few, DATA).collect()
    assert name == "packing" and sorted(r.length for r in found) == [1, 1, 2] and len({r.sequence_id for r in found}) == 1
    assert run(spark, few.limit(0), DATA).count() == 0


def test_run_applies_all_stages(spark, documents):
    found = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in found}
    assert 0 < len(kept) < documents.count() and kept <= {r.doc_id for r in documents.collect()}
    whole = sum(r.length for r in found if r.piece == 0 or r.start)
    assert whole == sum(r.length for r in found) and all(r.offset + r.length <= 4096 for r in found)


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, nothing, documents, stage):
    """Stages return the columns of documents, with nulls and without rows."""
    name, run = corpus_pipeline.STAGES[stage]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", None, "s", 4), (3, "a clean text of seven plain words", "en", "s", 33)]
    few = spark.createDataFrame(rows, documents.schema)
    found = run(spark, few, DATA)
    assert found.columns == documents.columns and found.count() == 4
    assert run(spark, few.limit(0), DATA).count() == 0
