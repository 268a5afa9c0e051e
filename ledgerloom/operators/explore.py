"""Search, look-up, what-if and decisions over classified rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Filter:
    """Optional predicates; None does not filter. A row without a value fails a range."""

    verdicts: tuple[str, ...] | None = None
    text: str | None = None
    least_diff: float | None = None
    most_diff: float | None = None
    since: str | None = None
    until: str | None = None

    def columns(self) -> list[Column]:
        diff = F.round(F.abs(F.col("g_taxable") - F.col("p_taxable")), 2)
        day = F.coalesce("g_date", "p_date")
        holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit((self.text or "").lower()))
        found = holds("g_vendor") | holds("p_vendor") | holds("g_doc") | holds("p_doc")
        wanted = [
            (self.verdicts, lambda: F.col("verdict").isin(*self.verdicts)), (self.text, lambda: found), (self.least_diff, lambda: diff >= self.least_diff), (self.most_diff, lambda: diff <= self.most_diff),
            (self.since, lambda: day >= F.lit(self.since).cast("date")), (self.until, lambda: day <= F.lit(self.until).cast("date")),
        ]
        return [make() for value, make in wanted if value is not None]


def search(rows: DataFrame, wanted: Filter, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows that pass all predicates; a page of them in order of row_idx if a limit is given."""
    for c in wanted.columns():
        rows = rows.where(c)
    return rows if limit is None else rows.orderBy("row_idx").offset(offset).limit(limit)


def related(rows: DataFrame, row_idx: int, most: int = 9) -> DataFrame:
    """Other rows of a row's vendor."""
    vendor = F.coalesce(F.nullif("g_vendor", F.lit("")), "p_vendor")
    named = rows.withColumn("vendor", vendor)
    return named.join(named.where(F.col("row_idx") == row_idx).select("vendor"), "vendor", "left_semi").where(F.col("row_idx") != row_idx).orderBy("row_idx").limit(most)


def what_if(spark: SparkSession, pairs: DataFrame, amounts: list[float], days: list[int]) -> DataFrame:
    """How many pairs (amount_diff, days) each combination of tolerances lets through.

    Pairs are counted by difference first; the grid, a few rows of parameters, meets these counts only.
    """
    steps = lambda c, values: F.coalesce(*(F.when(F.col(c) <= v, F.lit(v)) for v in sorted(values)))
    cells = pairs.groupBy(steps("amount_diff", amounts).alias("a"), steps("days", days).alias("d")).agg(F.count("*").alias("n")).where("a is not null and d is not null")
    grid = spark.createDataFrame([(float(a), int(d)) for a in amounts for d in days], "amount double, day int")
    inside = (F.col("a") <= F.col("amount")) & (F.col("d") <= F.col("day"))
    return grid.join(F.broadcast(cells), inside, "left").groupBy("amount", "day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def blockers(pairs: DataFrame, amount: float, days: int) -> DataFrame:
    """Pairs with the list of the rules that they fail."""
    failed = F.array_compact(F.array(F.when(F.col("amount_diff") > amount, "taxable_value"), F.when(F.col("days") > days, "document_date")))
    return pairs.withColumn("blockers", failed).withColumn("passes", F.size("blockers") == 0)


def bulk_approvable(candidates: DataFrame, decided: DataFrame, threshold: float = 0.92, margin: float = 0.05) -> DataFrame:
    """Candidates with `skip`: the first reason not to approve, or null.

    Within the batch a G row and a P row are used once, by the best score, then the smallest g_idx. decided: g_idx, p_idx consumed before.
    """
    used = lambda c: decided.select(c).distinct().withColumn(f"used_{c}", F.lit(True))
    rows = candidates.join(used("g_idx"), "g_idx", "left").join(used("p_idx"), "p_idx", "left")
    first = (
        F.when(F.col("status") == "AMBIGUOUS", "AMBIGUOUS").when(F.col("used_g_idx"), "G_CONSUMED").when(F.col("used_p_idx"), "P_CONSUMED").when(F.col("status") != "NEAR_MATCH_PROPOSED", "NOT_ELIGIBLE")
        .when(F.col("score") < threshold, "BELOW_THRESHOLD").when(~F.col("reciprocal"), "NOT_RECIPROCAL").when(F.col("gap") < margin, "GAP_TOO_SMALL")
    )
    rows = rows.withColumn("skip", first)
    nth = lambda c: F.row_number().over(Window.partitionBy(c, F.col("skip").isNull()).orderBy(F.desc("score"), "g_idx"))
    rows = rows.withColumn("ng", nth("g_idx")).withColumn("np", nth("p_idx"))
    again = F.col("skip").isNull() & ((F.col("ng") > 1) | (F.col("np") > 1))
    return rows.withColumn("skip", F.when(again, "DUPLICATE_IN_BATCH").otherwise(F.col("skip"))).drop("ng", "np", "used_g_idx", "used_p_idx")


def overlay(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows with the verdicts of decisions (row_idx, new_verdict, at); the latest of a row counts, and summaries are computed anew from the result."""
    last = decisions.groupBy("row_idx").agg(F.max_by("new_verdict", "at").alias("new_verdict"))
    return rows.join(last, "row_idx", "left").withColumn("verdict", F.coalesce("new_verdict", "verdict")).drop("new_verdict")


def unknown_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions about rows that don't exist: an error to report, never applied elsewhere."""
    return decisions.join(rows.select("row_idx"), "row_idx", "left_anti")
