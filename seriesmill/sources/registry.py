"""Fitted parameters stored by model name and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DEFAULT_VERSION = "1.0"
TAG = "version_tag"


def save_model(
    params: DataFrame, path: str, name: str, version: str = DEFAULT_VERSION,
    model_type: str | None = None, parameters: dict[str, str] | None = None, created: str | None = None,
) -> None:
    """Store the parameter rows of a fitted model with its description; a version saved before is replaced."""
    described = F.create_map(*[F.lit(x) for pair in (parameters or {}).items() for x in pair])
    if not parameters:
        described = F.expr("cast(map() as map<string,string>)")
    stamp = F.lit(created).cast("timestamp") if created else F.current_timestamp()
    row = params.drop("model").withColumns({
        "model_type": F.lit(model_type or name),
        "parameters": described,
        "created": stamp,
    })
    # One folder per model: models differ in their parameter columns.
    # The "v" keeps a version such as 1.10 from being read back as a number.  Only this version's folder is replaced.
    tagged = row.withColumn(TAG, F.concat(F.lit("v"), F.lit(version)))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(TAG).parquet(
        f"{path.rstrip('/')}/model_name={name}"
    )


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/model_name={name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no model {name!r} below {path}") from error


def load_model(spark: SparkSession, path: str, name: str, version: str = DEFAULT_VERSION) -> DataFrame:
    """Parameter rows of one version; only its partition is read."""
    rows = _read(spark, path, name).where(F.col(TAG) == f"v{version}")
    if rows.isEmpty():
        raise FileNotFoundError(f"no version {version} of model {name!r} below {path}")
    return rows.withColumns({"model": F.lit(name), "version": F.lit(version)}).drop(TAG)


def model_versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _read(spark, path, name).select(F.expr(f"substring({TAG}, 2)").alias("version")).distinct()
