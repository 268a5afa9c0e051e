"""Table access by directory; works for any URI that Spark's readers accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """Delimited text with a header: chosen columns under the names that operators use (file name to name), as text."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", False).csv(path)
    return raw.select(*(raw[f"`{c}`"].alias(n) for c, n in columns.items()))
