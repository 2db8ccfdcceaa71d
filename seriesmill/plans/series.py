"""Series shaping, statistics and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import series as s
from seriesmill.operators import stats
from seriesmill.operators.models import DecomposeModel, decompose
from seriesmill.operators.models.ssa import moments
from seriesmill.plans.base import Query, with_
from seriesmill.plans.tables import BRAND, FILLED, PLACED, SUPPLIER, Tables


def _sorted(t: Tables):
    raw = s.spread_rows(t.table("lineitem").select("l_suppkey", "l_shipdate", "l_orderkey"), t.lines, "l_suppkey", "l_shipdate")
    lines = raw.select(F.col("l_suppkey").cast("string").alias("series_key"), F.col("l_shipdate").cast("date").alias("ds"), "l_orderkey")
    arrival = s.deal_rows(lines, t.lines, "series_key", "ds").groupBy("series_key", "ds").agg(F.min("l_orderkey").alias("_first"))
    return s.sortedness(t.by_key(arrival.withColumn("arrival", F.struct("_first", "ds"))), "arrival")


def _date_range(t: Tables):
    # The range test sits on the bare scan column and reaches the Parquet reader.
    lines = s.between_dates(t.table("lineitem"), "1996-01-01", "1996-12-31", "l_shipdate")
    return s.to_series(lines, "l_suppkey", "l_shipdate", "l_quantity", rows=t.lines)


def _padded(t: Tables):
    marked = s.train_test_split(t.supplier_by_key())
    recent = s.head(marked.where(F.col("part") == "recent"), 5)
    return s.pad_with_history(recent, marked.where(F.col("part") == "train"), 14)


def _appended(t: Tables):
    filled = t.brand_filled()
    model = DecomposeModel()
    return s.append_forecast(filled, model.predict(model.fit(filled), 14))


def _embedding(t: Tables):
    rows = stats.embedding(t.brand_filled(), 7)
    return rows.select("series_key", "ds", *[F.element_at("v", j + 1).alias(f"v{j}") for j in range(7)])


DECOMPOSED = """
profile0 AS (SELECT series_key, i % 7 AS pos, avg(y) AS m FROM filled GROUP BY 1, 2),
profile AS (SELECT series_key, pos, m - avg(m) OVER (PARTITION BY series_key) AS seasonal FROM profile0),
trended AS (SELECT *, avg(y) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM filled),
parts AS (SELECT t.series_key, t.ds, t.i, t.n, t.y, t.trend, p.seasonal, t.y - t.trend - p.seasonal AS residual
  FROM trended t JOIN profile p ON t.series_key = p.series_key AND t.i % 7 = p.pos)"""

DECOMPOSE_FORECAST = """
ends AS (SELECT series_key, max(ds) AS last_ds, max(CASE WHEN i = n - 1 THEN trend END) AS t1,
  max(CASE WHEN i = n - 2 THEN trend END) AS t2, stddev_samp(residual) AS sd FROM parts GROUP BY 1),
forecast AS (SELECT e.series_key, 'decompose' AS model, h.step, e.last_ds + CAST(h.step AS INT) AS ds,
  greatest(0, e.t1 + h.step * (e.t1 - e.t2) + p.seasonal) AS yhat,
  greatest(0, greatest(0, e.t1 + h.step * (e.t1 - e.t2) + p.seasonal) - 1.96 * e.sd * sqrt(h.step)) AS lo,
  greatest(0, e.t1 + h.step * (e.t1 - e.t2) + p.seasonal) + 1.96 * e.sd * sqrt(h.step) AS hi
  FROM ends e CROSS JOIN (SELECT unnest(generate_series(1, 14)) AS step) h
  JOIN profile p ON p.series_key = e.series_key AND p.pos = (h.step - 1) % 7)"""

QUERIES = [
    Query("daily_series", "series_key ds:d y:r", lambda t: t.brand(), with_(BRAND, select="SELECT * FROM series")),
    Query(
        "gap_filled_series", "series_key ds:d y:r i:i n:i", lambda t: t.brand_filled(),
        with_(BRAND, FILLED, select="SELECT * FROM filled"),
    ),
    Query(
        "recent_n", "series_key ds:d y:r", lambda t: s.recent_n(t.supplier(), 30),
        with_(SUPPLIER, select="SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) <= 30"),
    ),
    Query(
        "series_head", "series_key ds:d y:r", lambda t: s.head(t.supplier(), 10),
        with_(SUPPLIER, select="SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds) <= 10"),
    ),
    Query(
        "series_skip", "series_key ds:d y:r", lambda t: s.skip(t.supplier_by_key(), 500),
        with_(SUPPLIER, select="SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds) > 500"),
    ),
    Query(
        "train_test_split", "series_key ds:d y:r part", lambda t: s.train_test_split(t.supplier_by_key()),
        with_(SUPPLIER, PLACED, select="SELECT *, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'recent' END AS part FROM placed"),
    ),
    Query(
        "sortedness", "series_key inversions:i is_sorted:b", _sorted,
        """WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_key, CAST(l_shipdate AS DATE) AS ds, min(l_orderkey) AS f
             FROM lineitem GROUP BY 1, 2),
           b AS (SELECT *, lead(ds) OVER (PARTITION BY series_key ORDER BY f, ds) AS nx FROM a)
           SELECT series_key, count(*) FILTER (nx < ds) AS inversions, count(*) FILTER (nx < ds) = 0 AS is_sorted FROM b GROUP BY 1""",
    ),
    Query(
        "date_range", "series_key ds:d y:r", _date_range,
        with_(SUPPLIER, select="SELECT * FROM series WHERE ds BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    ),
    Query(
        "short_series", "series_key n:i reason", lambda t: s.split_by_length(t.supplier_by_key(), 540)[1],
        with_(SUPPLIER, select="SELECT series_key, count(*) AS n, 'too_short' AS reason FROM series GROUP BY 1 HAVING count(*) < 540"),
    ),
    Query(
        "padded_window", "series_key ds:d y:r", _padded,
        with_(
            SUPPLIER, PLACED,
            select="SELECT series_key, ds, y FROM placed WHERE i >= floor(n * 0.8) - 9 AND i < floor(n * 0.8) + 5",
        ),
    ),
    Query(
        "history_with_forecast", "series_key ds:d y:r is_forecast:b", _appended,
        with_(
            BRAND, FILLED, DECOMPOSED, DECOMPOSE_FORECAST,
            select="SELECT series_key, ds, y, false AS is_forecast FROM filled UNION ALL SELECT series_key, ds, yhat, true FROM forecast",
        ),
    ),
    Query(
        "centered_moving_average", "series_key ds:d trend:r",
        lambda t: t.supplier_filled().withColumn("trend", stats.moving_average(7)),
        with_(
            SUPPLIER, FILLED,
            select="""SELECT series_key, ds, avg(y) OVER (PARTITION BY series_key ORDER BY i
                      ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM filled""",
        ),
    ),
    Query(
        "seasonal_profile", "series_key position:i seasonal:r", lambda t: stats.seasonal_profile(t.brand_filled()),
        with_(BRAND, FILLED, DECOMPOSED, select="SELECT series_key, pos AS position, seasonal FROM profile"),
    ),
    Query(
        "weekday_deviation", "series_key position:i deviation:r", lambda t: stats.weekday_deviation(t.brand_filled()),
        with_(
            BRAND, FILLED,
            select="""SELECT f.series_key, f.i % 7 AS position, avg(f.y) - any_value(m.m) AS deviation FROM filled f
                      JOIN (SELECT series_key, avg(y) AS m FROM filled GROUP BY 1) m ON f.series_key = m.series_key GROUP BY 1, 2""",
        ),
    ),
    Query(
        "decompose", "series_key ds:d y:r trend:r seasonal:r residual:r", lambda t: decompose(t.brand_filled()),
        with_(BRAND, FILLED, DECOMPOSED, select="SELECT * FROM parts"),
    ),
    Query(
        "linear_trend", "series_key n:i slope:r", lambda t: stats.linear_trend(t.supplier_filled()),
        with_(SUPPLIER, FILLED, select="SELECT series_key, count(*) AS n, regr_slope(y, i) AS slope FROM filled GROUP BY 1"),
    ),
    Query(
        "stddev_variants", "series_key n:i sd_sample:r sd_or_zero:r sd_floor_one:r sd_floor_tenth:r",
        lambda t: stats.deviation_variants(t.supplier()),
        with_(
            SUPPLIER,
            select="""SELECT series_key, count(*) AS n, stddev_samp(y) AS sd_sample, coalesce(stddev_samp(y), 0) AS sd_or_zero,
                      greatest(1.0, stddev_pop(y)) AS sd_floor_one, greatest(0.1, stddev_pop(y)) AS sd_floor_tenth
                      FROM series GROUP BY 1""",
        ),
    ),
    Query(
        "embedding_windows", "series_key ds:d " + " ".join(f"v{j}:r" for j in range(7)), _embedding,
        with_(
            BRAND, FILLED,
            select="SELECT series_key, ds, " + ", ".join(
                f"lag(y, {6 - j}) OVER (PARTITION BY series_key ORDER BY i) AS v{j}" for j in range(7)
            ) + " FROM filled QUALIFY i >= 6",
        ),
    ),
    Query(
        "ssa_moments", "series_key a:i b:i mean_a:r covariance:r", lambda t: moments(t.brand_filled(), 7),
        with_(
            BRAND, FILLED,
            "lagged AS (SELECT series_key, " + ", ".join(
                f"lead(y, {j}) OVER (PARTITION BY series_key ORDER BY i) AS v{j}" for j in range(7)
            ) + ", i, n FROM filled QUALIFY i <= n - 7)",
            select=" UNION ALL ".join(
                f"SELECT series_key, {a} AS a, {b} AS b, avg(v{a}) AS mean_a, covar_samp(v{a}, v{b}) AS covariance FROM lagged GROUP BY 1"
                for a in range(7) for b in range(a, 7)
            ),
        ),
    ),
]
