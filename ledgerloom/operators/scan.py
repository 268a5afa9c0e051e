"""Running values, numbers and neighbours inside groups of any size.

A window sorts a whole group in one task. Here a group of more than GROUP rows is cut instead: rows are dealt by ranges of group and order, each range is scanned alone, and what the ranges before it add up to comes
from one row for each range. Results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.store import materialize

#: Rows of a group that one task may sort.
GROUP = 500_000


def largest(rows: DataFrame, by: list[str]) -> int:
    """How many rows the largest group has."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def running_count(rows: DataFrame, by: list[str], order: list[str | Column], flag: Column, name: str) -> DataFrame:
    """rows with `name`: in how many rows of the group up to this one flag holds. by is never null; order must leave no ties that matter."""
    one, w = F.when(flag, 1).otherwise(0).cast("long"), Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if largest(rows, by) <= GROUP:
        return rows.withColumn(name, F.sum(one).over(w))
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part", *by).agg(F.sum(one).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(one).over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(sums.select("_part", *by, before.alias("_before")), ["_part", *by]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in order inside each group."""
    return running_count(rows, by, order, F.lit(True), name)


def nearest(asked: DataFrame, items: DataFrame, by: list[str], k: int) -> DataFrame:
    """row, item, rank, apart: for each asked row (by, row, at) the k items (by, item, at) of its group with the nearest `at`, ties by item.

    They are among the k items before and the k after the row in order of `at`, so nothing is paired but 2 k candidates a row.
    """
    side = lambda df, item, row: df.select(*by, "at", item.cast("long").alias("item"), row.cast("long").alias("row"))
    line = materialize(side(items, F.col("item"), F.lit(None)).unionByName(side(asked, F.lit(None), F.col("row"))), "line")
    near = None
    for first in (F.asc("at"), F.desc("at")):  # items up to the row, then items from the row on; the smallest of equal items stands next to it
        placed = running_count(line, by, [first, F.col("item").isNull(), F.desc("item"), "row"], F.col("item").isNotNull(), "n")
        there = placed.where("item IS NOT NULL").select(*by, "n", "item", F.col("at").alias("there"))
        here = placed.where("row IS NOT NULL").select(*by, "row", F.col("at").alias("here"), F.explode(F.sequence(F.col("n") - k + 1, F.col("n"))).alias("n")).where("n > 0")
        found = here.join(there, [*by, "n"]).select("row", "item", F.abs(F.col("here") - F.col("there")).alias("apart"))
        near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("row").orderBy("apart", "item"))
    return near.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
