"""Session helpers shared by operators that run Python on executors."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch between Spark and Python: long texts then bound a worker's memory as short ones do.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Spark takes a table's files for its size. Rows of a few numbers take ten times that and more once they are broadcast, and all broadcasts of a query stand in the driver's memory.
SIZES = {"spark.sql.sources.fileCompressionFactor": "10"}

ROOT = str(Path(__file__).resolve().parents[2])


def prefer(spark: SparkSession, wanted: dict[str, str]) -> None:
    """Set what the user has not set."""
    for key, value in wanted.items():
        if key not in dict(spark.sparkContext.getConf().getAll()):
            spark.conf.set(key, value)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (local mode, a shared checkout), and bound their batches."""
    prefer(spark, BATCH)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
