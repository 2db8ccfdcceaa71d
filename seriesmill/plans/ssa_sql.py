"""Singular-spectrum rules in plain SQL, for checking.

The leading eigen-projections of a covariance matrix come from squaring it until
only its dominant direction is left, then removing that direction and repeating.
"""

from __future__ import annotations

SQUARINGS = 20


def moment_tables(name: str, source: str, size: int) -> list[str]:
    """``{name}_mean(g, a, m)`` and ``{name}_c0(g, a, b, v)`` from ``source(g, i, n, y)``."""
    lags = ", ".join(f"lead(y, {j}) OVER (PARTITION BY g ORDER BY i) AS v{j}" for j in range(size))
    means = " UNION ALL ".join(f"SELECT g, {a} AS a, avg(v{a}) AS m FROM {name}_rows GROUP BY 1" for a in range(size))
    cells = ", ".join(f"covar_samp(v{a}, v{b}) AS c{a}_{b}" for a in range(size) for b in range(a, size))
    unfold = " UNION ALL ".join(
        f"SELECT g, {a} AS a, {b} AS b, c{min(a, b)}_{max(a, b)} AS v FROM {name}_cells" for a in range(size) for b in range(size)
    )
    return [
        f"{name}_rows AS MATERIALIZED (SELECT g, {lags}, i, n FROM {source} WHERE n >= {2 * size} QUALIFY i <= n - {size})",
        f"{name}_cells AS MATERIALIZED (SELECT g, {cells} FROM {name}_rows GROUP BY 1)",
        f"{name}_mean AS MATERIALIZED ({means})",
        f"{name}_c0 AS MATERIALIZED ({unfold})",
    ]


def projection_tables(name: str, components: int) -> list[str]:
    """``{name}_p1 … {name}_p{components}``: projections on the leading directions."""
    scaled = "v / sum(CASE WHEN a = b THEN v END) OVER (PARTITION BY g) AS v"
    parts = []
    for c in range(1, components + 1):
        previous = f"{name}_q{c}_0"
        parts.append(f"{previous} AS MATERIALIZED (SELECT g, a, b, {scaled} FROM {name}_c{c - 1})")
        for k in range(1, SQUARINGS + 1):
            current = f"{name}_p{c}" if k == SQUARINGS else f"{name}_q{c}_{k}"
            parts.append(
                f"{current} AS MATERIALIZED (SELECT g, a, b, {scaled} FROM (SELECT x.g, x.a, y.b, sum(x.v * y.v) AS v "
                f"FROM {previous} x JOIN {previous} y ON x.g = y.g AND x.b = y.a GROUP BY 1, 2, 3))"
            )
            previous = current
        if c < components:
            parts.append(
                f"{name}_c{c} AS MATERIALIZED (SELECT m.g, m.a, m.b, m.v - l.v * p.v AS v FROM {name}_c{c - 1} m "
                f"JOIN {name}_p{c} p ON m.g = p.g AND m.a = p.a AND m.b = p.b "
                f"JOIN (SELECT m.g, sum(m.v * p.v) AS v FROM {name}_c{c - 1} m JOIN {name}_p{c} p "
                f"ON m.g = p.g AND m.a = p.a AND m.b = p.b GROUP BY 1) l ON m.g = l.g)"
            )
    return parts


def rule_table(name: str, rule: str, size: int, components: int) -> str:
    """``{rule}(g, a, w)``: intercept and list of weights for the last coordinate."""
    stacked = " UNION ALL ".join(f"SELECT g, b, v FROM {name}_p{c} WHERE a = {size - 1}" for c in range(1, components + 1))
    return (
        f"{rule} AS MATERIALIZED (SELECT w.g, any_value(e.m) - sum(m.m * w.v) AS a, list(w.v ORDER BY w.b) AS w "
        f"FROM (SELECT g, b, sum(v) AS v FROM ({stacked}) GROUP BY 1, 2) w JOIN {name}_mean m ON w.g = m.g AND w.b = m.a "
        f"JOIN {name}_mean e ON w.g = e.g AND e.a = {size - 1} GROUP BY 1)"
    )


def rule_tables(rule: str, source: str, size: int, components: int) -> list[str]:
    return [*moment_tables(rule, source, size), *projection_tables(rule, components), rule_table(rule, rule, size, components)]


def forecast_tables(rule: str, size: int, train: str, horizon: int = 14) -> list[str]:
    """``ssa_forecast`` from the rule, the newest values and the spread of the ``train`` rows."""
    dot = "a + list_sum(list_transform(h, lambda x, j: x * w[j]))"
    return [
        f"""tails AS (SELECT series_key, max(ds) AS last_ds, list(y ORDER BY i) FILTER (i >= n - {size}) AS h,
             greatest(1, stddev_pop(y) FILTER ({train})) AS sd FROM filled GROUP BY 1)""",
        f"""ssa AS (SELECT t.series_key, last_ds, sd, a, w, h, 0 AS k, CAST(NULL AS DOUBLE) AS z FROM tails t JOIN {rule} r ON t.series_key = r.g
             UNION ALL SELECT series_key, last_ds, sd, a, w, list_append(h[2:], v), k + 1, v
             FROM (SELECT *, {dot} AS v FROM ssa WHERE k < {horizon}))""",
        """ssa_forecast AS (SELECT series_key, 'ssa' AS model, k AS step, last_ds + CAST(k AS INT) AS ds, z AS yhat,
             greatest(0, z - 1.96 * sd) AS lo, z + 1.96 * sd AS hi FROM ssa WHERE k > 0)""",
    ]


def recurrent_tables(name: str, size: int, components: int, horizon: int = 14) -> list[str]:
    """``ssa_forecast`` by the linear recurrence of the leading directions, from the rebuilt end of ``filled``.

    Every one of the last windows is projected in full, and a day's value is the mean over the windows that hold it.
    """
    stacked = " UNION ALL ".join(f"SELECT g, a, b, v FROM {name}_p{c}" for c in range(1, components + 1))
    last = size - 1
    return [
        f"proj AS MATERIALIZED (SELECT g, a, b, sum(v) AS v FROM ({stacked}) GROUP BY 1, 2, 3)",
        f"""ends AS (SELECT series_key AS g, i - (n - {2 * size - 2}) AS t, y FROM filled WHERE i >= n - {2 * size - 2} AND n >= {2 * size})""",
        f"""rebuilt AS (SELECT p.g, s + p.a AS t, any_value(m.m) + sum(p.v * (e.y - mb.m)) AS v
             FROM proj p CROSS JOIN (SELECT unnest(generate_series(0, {size - 2})) AS s) w
             JOIN ends e ON e.g = p.g AND e.t = s + p.b JOIN {name}_mean m ON m.g = p.g AND m.a = p.a JOIN {name}_mean mb ON mb.g = p.g AND mb.a = p.b
             GROUP BY p.g, s, p.a)""",
        f"""start AS (SELECT g, list(v ORDER BY t) AS h FROM (SELECT g, t, avg(v) AS v FROM rebuilt WHERE t >= {size - 1} GROUP BY 1, 2) GROUP BY 1)""",
        f"""rule AS (SELECT p.g, any_value(e.m) - sum(m.m * p.v / (1 - q.v)) AS a, list(p.v / (1 - q.v) ORDER BY p.b) AS w
             FROM proj p JOIN proj q ON p.g = q.g AND q.a = {last} AND q.b = {last} JOIN {name}_mean m ON m.g = p.g AND m.a = p.b
             JOIN {name}_mean e ON e.g = p.g AND e.a = {last} WHERE p.a = {last} AND p.b < {last} GROUP BY 1)""",
        "tails AS (SELECT series_key, max(ds) AS last_ds, greatest(1, stddev_pop(y)) AS sd FROM filled GROUP BY 1)",
        f"""ssa AS (SELECT t.series_key, last_ds, sd, a, w, h, 0 AS k, CAST(NULL AS DOUBLE) AS z
             FROM tails t JOIN rule r ON t.series_key = r.g JOIN start s ON s.g = r.g
             UNION ALL SELECT series_key, last_ds, sd, a, w, list_append(h[2:], v), k + 1, v
             FROM (SELECT *, a + list_sum(list_transform(h, lambda x, j: x * w[j])) AS v FROM ssa WHERE k < {horizon}))""",
        """ssa_forecast AS (SELECT series_key, 'ssa' AS model, k AS step, last_ds + CAST(k AS INT) AS ds, z AS yhat,
             greatest(0, z - 1.96 * sd) AS lo, z + 1.96 * sd AS hi FROM ssa WHERE k > 0)""",
    ]
