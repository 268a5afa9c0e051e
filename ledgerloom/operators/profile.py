"""Column profiles and type hints in one pass over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.normalize import date, number

#: Fixed patterns of identifiers and dates.
TAX_ID = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"


PAN, HEX, PERCENT = "^[A-Z]{5}[0-9]{4}[A-Z]$", "^[0-9a-fA-F]{32,64}$", r"^[0-9]{1,2}(\.[0-9]+)?$|^100(\.0+)?$"
DATES = {"yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "dd-MM-yyyy": r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd/MM/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd-MMM-yyyy": r"^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$"}


def profile(df: DataFrame, columns: list[str] | None = None, samples: int = 3) -> DataFrame:
    """column, rows, non_null, null_percent, distinct, lowest, highest, shares of numbers, dates, tax ids, PANs, hashes and percentages, date_format, samples.

    Rows are unpivoted to (column, value) and aggregated with partial sums; the distinct count is exact. lowest and highest compare numbers and dates as such where all values are. samples: the smallest values.
    """
    columns = columns or df.columns
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("k"))
    v, k = F.col("value"), F.col("k")
    n = F.sum(F.when(v.isNotNull(), k).otherwise(0))
    share = lambda cond: F.round(F.sum(F.when(v.isNotNull() & cond, k).otherwise(0)) / F.nullif(n, F.lit(0)), 4)
    numeric, when = F.when(v.rlike(r"^-?[0-9]*\.?[0-9]+$"), v.try_cast("double")), date(v)
    nth = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    firsts = counted.where(v.isNotNull()).withColumn("_r", nth).where(F.col("_r") <= samples).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    out = counted.groupBy("column").agg(
        F.sum(k).alias("rows"), n.alias("non_null"), F.count("value").alias("distinct"), F.min_by("value", F.when(numeric.isNotNull(), F.struct(numeric, v))).alias("low_n"), F.max_by("value", F.when(numeric.isNotNull(), F.struct(numeric, v))).alias("high_n"),
        F.min_by("value", F.when(when.isNotNull(), F.struct(when, v))).alias("low_d"), F.max_by("value", F.when(when.isNotNull(), F.struct(when, v))).alias("high_d"), F.min("value").alias("low_s"), F.max("value").alias("high_s"),
        share(numeric.isNotNull()).alias("numeric_share"), share(when.isNotNull()).alias("date_share"), share(v.rlike(TAX_ID)).alias("tax_id_share"), share(v.rlike(PAN)).alias("pan_share"), share(v.rlike(HEX)).alias("hex_share"),
        share(v.rlike(PERCENT)).alias("percent_share"), *(share(v.rlike(x)).alias(f"_{i}") for i, x in enumerate(DATES.values())),
    )
    best = F.greatest(*(F.col(f"_{i}") for i in range(len(DATES))))
    style = F.when(best > 0, F.coalesce(*(F.when(F.col(f"_{i}") == best, name) for i, name in enumerate(DATES))))
    end = lambda e: F.when(F.col("numeric_share") == 1, F.col(f"{e}_n")).when(F.col("date_share") == 1, F.col(f"{e}_d")).otherwise(F.col(f"{e}_s"))
    out = out.withColumns({"lowest": end("low"), "highest": end("high"), "date_format": style, "null_percent": F.round(100.0 * (F.col("rows") - F.col("non_null")) / F.col("rows"), 2)})
    shares = ("numeric_share", "date_share", "tax_id_share", "pan_share", "hex_share", "percent_share")
    return out.join(firsts, "column", "left").select("column", "rows", "non_null", "null_percent", "distinct", "lowest", "highest", *shares, "date_format", "samples")


def inferred_types(profiles: DataFrame, numeric: float = 0.95, dates: float = 0.90) -> DataFrame:
    """column, type: number, date or string."""
    kind = F.when(F.col("numeric_share") >= numeric, "number").when(F.col("date_share") >= dates, "date").otherwise("string")
    return profiles.select("column", kind.alias("type"))


def available_rules(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, usable: whether a column has a value that isn't blank anywhere."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg((F.count_if(F.trim("value") != "") > 0).alias("usable"))
