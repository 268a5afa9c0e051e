"""Structured Streaming: rows that arrive later are matched as they come (an addition; the batch operators are complete without it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New parquet files of a directory as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_hits(g: DataFrame, arrivals: DataFrame, amount: float = 0.05) -> DataFrame:
    """g_idx, p_idx, d of arriving rows with a G row of equal vendor, document and date and a near amount.

    A stream-static join keeps no state. Consumption across batches is left to the sink, where repeated_use() shows conflicts.
    """
    left = g.select(F.col("row_idx").alias("g_idx"), "vendor", "doc", "d", F.col("taxable").alias("ga"))
    right = arrivals.select(F.col("row_idx").alias("p_idx"), "vendor", "doc", "d", F.col("taxable").alias("pa"))
    return right.join(left, ["vendor", "doc", "d"]).where(F.abs(F.col("ga") - F.col("pa")) <= amount).select("g_idx", "p_idx", "d")


def amounts_by_month(arrivals: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows and amount per vendor and 30-day window of the document date; windows close when the watermark has passed them."""
    timed = arrivals.withColumn("at", F.col("d").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "30 days"), "vendor").agg(F.count("*").alias("n"), F.sum("taxable").alias("taxable"))
