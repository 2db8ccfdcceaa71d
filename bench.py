"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times into the ``noop`` sink;
the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from seriesmill.operators import quality
from seriesmill.operators.models import DecomposeModel, LookbackModel, SsaModel, WeightedModel
from seriesmill.plans import callables
from seriesmill.plans.features import featured
from seriesmill.plans.tables import Tables
from seriesmill.session import build_session

HORIZON = 14


def headline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    catalogue = callables()

    def supplier(model):
        return lambda: model.predict(model.fit(t.supplier_filled()), HORIZON)

    return {
        "decompose": lambda: catalogue["decompose"](spark, sf_dir),
        "forecast_decompose": supplier(DecomposeModel()),
        "forecast_wma": supplier(WeightedModel()),
        "forecast_lookback": supplier(LookbackModel()),
        "forecast_ssa": supplier(SsaModel(7, 3)),
        "quality_report": lambda: quality.quality_report(t.supplier()),
        "store_features": lambda: featured(t),
        "cross_validate": lambda: catalogue["cross_validate"](spark, sf_dir),
        "grid_search_ssa": lambda: catalogue["grid_search_ssa"](spark, sf_dir),
        "recommendations": lambda: catalogue["recommendations"](spark, sf_dir),
        "stream_online_learner": lambda: catalogue["stream_online_learner"](spark, sf_dir),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, build in headline(spark, sf_dir).items():
        if only and name not in only:
            continue
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
