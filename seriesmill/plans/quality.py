"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import quality as q
from seriesmill.plans.base import Query, with_
from seriesmill.plans.tables import SIGNED, SUPPLIER

STATS = """
stats AS (SELECT series_key, count(*) AS total_records, count(*) FILTER (y < 0) AS negative_values, avg(y) AS mean,
  stddev_samp(y) AS sd FROM series GROUP BY 1),
scored AS (SELECT s.*, mean, sd, mean + 3 * sd AS upper_limit, abs((y - mean) / sd) AS zscore
  FROM series s JOIN stats t ON s.series_key = t.series_key),
ranges AS (SELECT series_key, count(*) FILTER (y < 0) AS negative_values, count(*) FILTER (y > upper_limit) AS oversize_values,
  count(*) FILTER (zscore > 3) AS anomalies, max(upper_limit) AS upper_limit FROM scored GROUP BY 1),
jumps AS (SELECT *, lag(ds) OVER (PARTITION BY series_key ORDER BY ds) AS previous_ds FROM series),
gaps AS (SELECT series_key, count(*) FILTER (previous_ds IS NOT NULL AND date_diff('day', previous_ds, ds) <> 1) AS date_gaps
  FROM jumps GROUP BY 1)"""

REPORT = """
SELECT s.series_key, total_records, s.negative_values AS missing_values, date_gaps, anomalies, s.negative_values, oversize_values,
  upper_limit, array_to_string(list_filter([
    CASE WHEN total_records < 30 THEN printf('too_short %.4f/30.0000', CAST(total_records AS DOUBLE)) END,
    CASE WHEN s.negative_values / total_records > 0.1 THEN printf('missing_share %.4f/0.1000', s.negative_values / total_records) END,
    CASE WHEN date_gaps > 0 THEN printf('date_gaps %.4f/0.0000', CAST(date_gaps AS DOUBLE)) END,
    CASE WHEN anomalies > 0 THEN printf('anomalies %.4f/0.0000', CAST(anomalies AS DOUBLE)) END,
    CASE WHEN s.negative_values > 0 THEN printf('negative %.4f/0.0000', CAST(s.negative_values AS DOUBLE)) END,
    CASE WHEN oversize_values > 0 THEN printf('oversize %.4f/0.0000', CAST(oversize_values AS DOUBLE)) END
  ], lambda x: x IS NOT NULL), '; ') AS issues
FROM stats s JOIN ranges r ON s.series_key = r.series_key JOIN gaps g ON s.series_key = g.series_key"""

_REPORT_COLUMNS = (
    "series_key is_valid:b total_records:i missing_values:i date_gaps:i anomalies:i negative_values:i "
    "oversize_values:i upper_limit:r issues"
)


def _report(rows):
    text = F.transform("issues", lambda x: F.format_string("%s %.4f/%.4f", x["code"], x["figure"], x["limit"]))
    return q.quality_report(rows).withColumn("issues", F.array_join(text, "; "))


def _guard_sql(share: float) -> str:
    return with_(
        SIGNED,
        select=f"""SELECT * FROM series WHERE y >= 0 AND series_key IN
                   (SELECT series_key FROM series GROUP BY 1 HAVING count(*) FILTER (y >= 0) >= count(*) * {share})""",
    )


QUERIES = [
    Query(
        "quality_report", _REPORT_COLUMNS, lambda t: _report(t.supplier_by_key()),
        with_(SUPPLIER, STATS, select=f"SELECT *, issues = '' AS is_valid FROM ({REPORT})"),
    ),
    Query(
        "quality_report_signed", _REPORT_COLUMNS, lambda t: _report(t.signed()),
        with_(SIGNED, STATS, select=f"SELECT *, issues = '' AS is_valid FROM ({REPORT})"),
    ),
    Query(
        "anomalies_zscore", "series_key ds:d value:r zscore:r mean:r sd:r side", lambda t: q.anomalies(t.supplier()),
        with_(
            SUPPLIER, STATS,
            select="""SELECT series_key, ds, y AS value, zscore, mean, sd, CASE WHEN y < mean THEN 'low' ELSE 'high' END AS side
                      FROM scored WHERE zscore > 3""",
        ),
    ),
    Query(
        "date_gaps", "series_key date_gaps:i", lambda t: q.date_gaps(t.supplier_by_key()),
        with_(SUPPLIER, STATS, select="SELECT * FROM gaps"),
    ),
    Query(
        "date_gap_rows", "series_key previous_ds:d ds:d missing_days:i", lambda t: q.gap_rows(t.supplier_by_key()),
        with_(
            SUPPLIER, STATS,
            select="SELECT *, date_diff('day', previous_ds, ds) - 1 AS missing_days FROM jumps WHERE date_diff('day', previous_ds, ds) <> 1",
        ),
    ),
    Query(
        "value_ranges", "series_key negative_values:i oversize_values:i anomalies:i upper_limit:r",
        lambda t: q.value_ranges(t.signed()), with_(SIGNED, STATS, select="SELECT * FROM ranges"),
    ),
    Query(
        "valid_sales", "series_key ds:d y:r", lambda t: t.signed().where(q.is_valid()),
        with_(SIGNED, select="SELECT * FROM series WHERE y >= 0"),
    ),
    Query(
        "clean_with_guard", "series_key ds:d y:r", lambda t: q.clean_with_guard(t.signed()), _guard_sql(0.9),
    ),
    Query(
        "clean_with_strict_guard", "series_key ds:d y:r", lambda t: q.clean_with_guard(t.signed(), 0.94), _guard_sql(0.94),
    ),
    Query(
        "daily_duplicates", "series_key date_gaps:i",
        lambda t: q.date_gaps(t.with_part().select(
            F.col("p_brand").alias("series_key"), F.col("l_shipdate").cast("date").alias("ds"), F.col("l_quantity").alias("y")
        )),
        """WITH l AS (SELECT p_brand AS series_key, CAST(l_shipdate AS DATE) AS ds FROM lineitem JOIN part ON l_partkey = p_partkey),
           p AS (SELECT *, lag(ds) OVER (PARTITION BY series_key ORDER BY ds) AS pr FROM l)
           SELECT series_key, count(*) FILTER (pr IS NOT NULL AND date_diff('day', pr, ds) <> 1) AS date_gaps FROM p GROUP BY 1""",
    ),
]
