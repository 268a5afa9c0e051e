"""Counts, rates and stratifications of classified rows. Money is summed as decimals and cast last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MATCHED = ("Exact Match", "Tolerance Match", "Near Match", "Consolidated Match")


def money(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def bucket_counts(rows: DataFrame, by: str = "verdict") -> DataFrame:
    """n, the amounts and the taxes of both sides per bucket."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(money(c).alias(c) for c in ("g_taxable", "p_taxable", "g_tax", "p_tax")))


def match_rate(rows: DataFrame) -> DataFrame:
    """One row: total, matched, rate in percent with one digit."""
    hit = F.count_if(F.col("verdict").isin(*MATCHED))
    return rows.agg(F.count("*").alias("total"), hit.alias("matched"), F.round(100.0 * hit / F.nullif(F.count("*"), F.lit(0)), 1).alias("rate"))


def yields(rows: DataFrame, tiers: list[str]) -> DataFrame:
    """Per verdict in the order of tiers: n, tax, running n and what remains in percent of all rows after it. The window sees one row a verdict."""
    at = F.create_map(*[x for i, t in enumerate(tiers) for x in (F.lit(t), F.lit(i))])
    total = F.sum("n").over(Window.partitionBy())
    per = rows.groupBy("verdict").agg(F.count("*").alias("n"), money(tax_of()).alias("tax")).withColumn("_total", total).withColumn("tier", at[F.col("verdict")]).where("tier is not null")
    upto = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("running", F.sum("n").over(upto)).withColumn("left_percent", F.round(100.0 * (F.col("_total") - F.col("running")) / F.col("_total"), 1)).drop("_total")


def tax_of() -> Column:
    """A row's tax: that of G, or of P where G is missing."""
    return F.when(F.col("g_vendor") != "", F.col("g_tax")).otherwise(F.col("p_tax"))


def vendor_risk(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Per vendor: invoices, matched, claimable and disputed tax, match percent and risk, judged by the percentage before rounding; limit: the vendors with most disputed tax only."""
    vendor = F.coalesce(F.nullif("g_vendor", F.lit("")), "p_vendor")
    hit = F.col("verdict").isin(*MATCHED)
    out = rows.groupBy(vendor.alias("vendor")).agg(F.count("*").alias("invoices"), F.count_if(hit).alias("matched"), money(F.when(hit, tax_of()).otherwise(0.0)).alias("claimable"), money(F.when(~hit, tax_of()).otherwise(0.0)).alias("disputed"))
    percent = 100.0 * F.col("matched") / F.col("invoices")
    out = out.withColumn("match_percent", F.round(percent, 1)).withColumn("risk", F.when(percent < 70, "HIGH").when(percent < 90, "MED").otherwise("LOW"))
    return out if limit is None else out.orderBy(F.desc("disputed"), "vendor").limit(limit)


def claims(rows: DataFrame) -> DataFrame:
    """One row: claimable and disputed tax of all rows."""
    hit = F.col("verdict").isin(*MATCHED)
    return rows.agg(money(F.when(hit, tax_of()).otherwise(0.0)).alias("claimable"), money(F.when(~hit, tax_of()).otherwise(0.0)).alias("disputed"))


def disposition_matrix(rows: DataFrame) -> DataFrame:
    """Per verdict: n and its percentage of the rows of its own ledger: P for what only P has, else G."""
    total = lambda s: F.sum(f"{s}_n").over(Window.partitionBy())
    per = rows.groupBy("verdict").agg(F.count("*").alias("n"), *(F.count_if(F.col(f"{s}_vendor") != "").alias(f"{s}_n") for s in "gp"))
    of = F.when(F.col("verdict") == "PR Only", total("p")).otherwise(total("g"))
    return per.withColumn("percent", F.round(100.0 * F.col("n") / F.nullif(of, F.lit(0)), 1)).select("verdict", "n", "percent")


def top_vendors(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The vendors with most rows that did not match."""
    vendor = F.coalesce(F.nullif("g_vendor", F.lit("")), "p_vendor")
    return rows.where(~F.col("verdict").isin(*MATCHED)).groupBy(vendor.alias("vendor")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vendor").limit(limit)


def variance_bands(rows: DataFrame) -> DataFrame:
    """Rows with both sides by the size of the amount difference."""
    diff = F.round(F.abs(F.col("g_taxable") - F.col("p_taxable")), 2)
    band = F.when(diff < 100, "below 100").when(diff <= 1000, "100 to 1000").otherwise("above 1000")
    return rows.where("g_vendor != '' and p_vendor != ''").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def top_mismatches(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The largest differences of rows with both sides that did not match."""
    diff = F.round(F.abs(F.col("g_taxable") - F.col("p_taxable")), 2).alias("diff")
    return rows.where(~F.col("verdict").isin(*MATCHED)).where("g_vendor != '' and p_vendor != ''").select("row_idx", "verdict", diff).orderBy(F.desc("diff"), "row_idx").limit(limit)


def totals(g: DataFrame, p: DataFrame) -> DataFrame:
    """One row: rows and amounts of both ledgers, and the net difference."""
    side = lambda df, s: df.agg(F.count("*").alias(f"{s}_rows"), F.sum("taxable").alias(f"_{s}"))
    both = side(g, "g").crossJoin(side(p, "p"))  # one row each
    return both.select("g_rows", "p_rows", *(F.col(f"_{s}").cast("double").alias(f"{s}_taxable") for s in "gp"), (F.col("_g") - F.col("_p")).cast("double").alias("net"))


def repeated_use(links: DataFrame, column: str) -> DataFrame:
    """Keys that more than one link consumes: empty where one-to-one holds."""
    return links.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def multiset_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: how many values the two columns have in common, counted with repeats."""
    count = lambda df, n: df.groupBy(column).agg(F.count("*").alias(n))
    return count(a, "x").join(count(b, "y"), column).agg(F.coalesce(F.sum(F.least("x", "y")), F.lit(0)).alias("overlap"))


def evaluation(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true positives, found, expected, precision, recall of pairs (g_idx, p_idx)."""
    hit = found.join(truth, ["g_idx", "p_idx"], "left_semi").agg(F.count("*").alias("hits"))
    one = hit.crossJoin(found.agg(F.count("*").alias("found"))).crossJoin(truth.agg(F.count("*").alias("expected")))  # one row each
    ratio = lambda n: F.round(F.col("hits") / F.nullif(F.col(n), F.lit(0)), 4)
    return one.withColumns({"precision": ratio("found"), "recall": ratio("expected")})


def triage(candidates: DataFrame) -> DataFrame:
    """Per category of ambiguity clusters (rows of rank 1): n and percentage of all clusters."""
    total = F.sum("n").over(Window.partitionBy())  # one row a category
    per = candidates.where("rank = 1").groupBy("category").agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.round(100.0 * F.col("n") / total, 1).cast("double"))


SUMS = ("n", "g_taxable", "p_taxable", "g_tax", "p_tax")


def contributions(rows: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    """What rows add to (sign 1) or take from (-1) sums per group: n and the amounts and taxes of both sides, as decimals."""
    amounts = [(F.col(c).cast("decimal(18,2)") * sign).alias(c) for c in SUMS[1:]]
    return rows.select(*by, F.lit(sign).cast("long").alias("n"), *amounts)


def totalled(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of contributions; groups that nothing is left of go."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n <> 0")


def kept_up(sums: DataFrame, before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """sums (totalled() of all rows) after some rows have changed: what the changed rows were is taken away, what they are is added. before: the changed rows as they were; after: as they are now, without those that are retired.

    Only sums and changed rows are read, and the result is what totalled() of all rows would give.
    """
    return totalled(sums.unionByName(contributions(before, by, -1)).unionByName(contributions(after, by)), by)
