"""Keyed demand time series on Spark: ingest, check, enrich, forecast, stock.

Every public function takes DataFrames and returns a lazy DataFrame.  A series
table has the columns ``series_key, ds (date), y (double)`` with one row per
key and day; that grain is what bounds every per-key window in the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with the job, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
