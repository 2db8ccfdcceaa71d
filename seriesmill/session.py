"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    app_name: str = "seriesmill", master: str | None = None, shared: str | None = None, **conf,
) -> SparkSession:
    """A session with the settings the package is tuned for; ``shared`` is the folder for tables between stages."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({CHECKPOINT_CONF: shared} if shared else {}),
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Without that setting a ``local`` session (one process, as in tests) gets a folder of its own; on a cluster
    that is an error, since executors would not see each other's files.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if path:
        return path.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    return _own_folder()


def is_local(master: str) -> bool:
    """One process: ``local`` or ``local[...]``, but not ``local-cluster[...]``."""
    return master == "local" or master.startswith("local[")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="seriesmill-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
