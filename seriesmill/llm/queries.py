"""The registered queries of this folder and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import ledger

    found = ledger.ledger(ledger.measure(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("bits").bitwiseAND(F.lit(ledger.mask(ledger.POLICIES["v1"])).cast("long")) != 0
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ledger.passes("v2")).alias("kept"), "bits",
    )


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import toxicity as T
    from seriesmill.llm.sampling import held_out

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    weights = T.fit(labels.where(~held_out("id")), docs.withColumnRenamed("doc_id", "id"))
    return docs.select("doc_id", held_out().alias("held_out"), T.score(weights).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, the posterior of its votes, and the votes; no label is used."""
    from seriesmill.llm import weak_quality as Q

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    _, patterns, scorer = Q.fit(docs.withColumnRenamed("doc_id", "id"))
    posteriors = spark.createDataFrame(
        [(list(map(int, k)), float(p)) for k, p in zip(patterns["key"], patterns["posterior"])], "votes array<int>, posterior double"
    ) if len(patterns) else spark.createDataFrame([], "votes array<int>, posterior double")
    scored = Q.with_votes(docs.withColumn("score", Q.score(scorer))).drop("text")
    return scored.join(F.broadcast(posteriors), "votes", "left").select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= 0.5).alias("kept"), "posterior", "votes")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import langid
    from seriesmill.llm.sampling import held_out

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = docs.where(~held_out()).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    model = langid.fit(labels, docs.select(F.col("doc_id").alias("id"), "text"))
    return docs.select("doc_id", held_out().alias("held_out"), langid.predict(model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import circulant_minhash as M

    found = M.near_duplicates(_table(spark, sf_dir, "documents"), M.Settings(shingle=2))
    return found.drop("th").withColumnRenamed("id", "doc_id")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import decontaminate as D

    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = D.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    c = "contamination"
    return found.select(
        "doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        D.items_sha256(f"{c}.items").alias("items_sha256"), f"{c}.contaminated")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import packing as P

    return P.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import wavelet

    return wavelet.round_trip(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of repeated line runs, and the lines and characters that went."""
    from seriesmill.llm import line_runs

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("before"))
    return line_runs.dedup_lines(docs).select(
        "doc_id", "text", "lines_deleted", (F.col("before") - F.length("text")).cast("long").alias("chars_deleted"))


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import tagpath

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", tagpath.main_text().alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import align

    return align.align(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import pitman_yor

    return pitman_yor.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesmill.llm import spelling as S

    return S.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity,
    "op2_quality": quality,
    "op3_near_dedup": near_dedup,
    "op4_decontamination": decontamination,
    "op5_line_dedup": line_dedup,
    "op6_extraction": extraction,
    "op7_packing": packing,
    "op8_language": language,
    "op9_quality_rules": quality_rules,
    "op10_token_files": token_files,
    "op11_alignment": alignment,
    "op12_lm_scores": lm_scores,
    "op13_spelling": spelling,
}
_WORDS_4 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    # All pairs that share a shingle are counted, and every document reaches its component by walking the links.
    "op3_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS key FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON r = links.a),
least_id AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id USING (doc_id)""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper,
  len(list_distinct(w)) AS n_distinct FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT)
  + 8 * CAST(n_lines >= 4 AND 2 * n_dup_lines > n_lines AS INT) + 16 * CAST(n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) AS INT)
  + 32 * CAST(n_words >= 10 AND 2 * n_upper > word_chars AS INT) + 64 * CAST(n_words >= 50 AND n_words < 1000 AND 5 * n_distinct < n_words AS INT) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS bits
FROM b""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_4} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_4} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS key
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS key
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
found AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, key)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    # Windows of lines are compared as text: the shortest run of 50 words from each line on, and up to each line.
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, i, len(regexp_extract_all(x[i], '[^\x20\x09-\x0D]+')) AS w FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l),
f AS (SELECT a.doc_id, a.i AS low, min(b.i) AS high FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY ALL),
g AS (SELECT a.doc_id, max(b.i) AS low, a.i AS high FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.c - b.c + b.w >= 50 GROUP BY a.doc_id, a.i),
r AS (SELECT doc_id, low, high, array_to_string(list_slice(x, low, high), chr(10)) AS key, high - low AS n
      FROM (SELECT * FROM f UNION SELECT * FROM g) JOIN d USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY key, n ORDER BY doc_id, low) AS k FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS i FROM o WHERE k > 1),
kept AS (SELECT doc_id, coalesce(string_agg(x[i], chr(10) ORDER BY i) FILTER (WHERE gone.doc_id IS NULL), '') AS text, count(gone.doc_id) AS n
         FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d) p LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, kept.text, CAST(coalesce(n, 0) AS BIGINT) AS lines_deleted, CAST(length(d.text) - length(kept.text) AS BIGINT) AS chars_deleted
FROM d LEFT JOIN kept USING (doc_id)""",
}
