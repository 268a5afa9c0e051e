"""Exact, tolerance and near matching of two ledgers, all of it joins and windows.

Ledgers have row_idx (unique, gives the order), record_id, vendor, doc, doc_type, d, taxable, rate, igst, cgst, sgst, cess.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import normalize, similarity
from ledgerloom.operators.bands import Band, band_join
from ledgerloom.sources.session import ensure_importable
from ledgerloom.sources.store import materialize

HEADS = ("igst", "cgst", "sgst", "cess")
MONEY = ("taxable", *HEADS)


def exact_key(df: DataFrame) -> list[Column]:
    """The ten normalised key fields; a null in any keeps the row out."""
    money = [F.round(F.col(c).cast("decimal(18,2)"), 2) for c in (*MONEY, "rate")]
    return [normalize.identifier(F.col("vendor")), normalize.blank_to_null(F.col("doc")), F.col("d"), normalize.identifier(F.col("doc_type")), *money]


def exact(g: DataFrame, p: DataFrame) -> DataFrame:
    """g_idx, p_idx: the k-th row of a key in G meets the k-th in P.

    Both sides are dealt by key together and numbered by row_idx there, so numbering and meeting take one shuffle.
    """
    keys = [f"k{i}" for i in range(len(exact_key(g)))]
    side = lambda df, of_g: df.select("row_idx", F.lit(of_g).alias("of_g"), *(k.alias(n) for k, n in zip(exact_key(df), keys))).dropna(subset=keys)
    rows = side(g, True).unionByName(side(p, False)).repartition(*keys)
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "of_g").orderBy("row_idx")))
    of = lambda mine, name: F.min(F.when(mine, F.col("row_idx"))).alias(name)
    met = nth.groupBy(*keys, "nth").agg(of(F.col("of_g"), "g_idx"), of(~F.col("of_g"), "p_idx"))
    return met.where("g_idx IS NOT NULL AND p_idx IS NOT NULL").select("g_idx", "p_idx")


def residual(df: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Rows that no match has consumed."""
    return df.join(matches.select(F.col(side).alias("row_idx")), "row_idx", "left_anti")


@dataclass(frozen=True)
class Policy:
    """Tolerances of the second stage; vendor and document must be equal."""

    amount: float = 10.0
    days: int = 5


def tolerance(g: DataFrame, p: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Matches (g_idx, p_idx, amount_diff, day_diff) that are each other's only candidates, and conflicts (g_idx, p_ids) of all other rows with a candidate."""
    left = g.select(F.col("row_idx").alias("g_idx"), F.upper(F.trim("vendor")).alias("v"), F.trim("doc").alias("n"), F.col("taxable").alias("ga"), F.col("d").alias("gd"))
    right = p.select(F.col("row_idx").alias("p_idx"), F.upper(F.trim("vendor")).alias("v"), F.trim("doc").alias("n"), F.col("taxable").alias("pa"), F.col("d").alias("pd"))
    pairs = left.join(right, ["v", "n"]).withColumn("amount_diff", F.abs(F.col("ga") - F.col("pa"))).withColumn("day_diff", normalize.days_apart(F.col("gd"), F.col("pd")))
    pairs = pairs.where((F.col("amount_diff") <= policy.amount) & (F.col("day_diff") <= policy.days))
    pairs = pairs.withColumn("of_g", F.count("*").over(Window.partitionBy("g_idx"))).withColumn("of_p", F.count("*").over(Window.partitionBy("p_idx")))
    only = (F.col("of_g") == 1) & (F.col("of_p") == 1)
    matches = pairs.where(only).select("g_idx", "p_idx", "amount_diff", "day_diff")
    conflicts = pairs.where(~only).groupBy("g_idx").agg(F.sort_array(F.collect_list("p_idx")).alias("p_ids"))
    return matches, conflicts


@dataclass(frozen=True)
class Near:
    """Thresholds of the third stage."""

    days: int = 30
    amount: float = 20_000.0
    share: float = 0.5
    invoice: float = 0.55
    least: float = 0.45
    proposal: float = 0.92
    margin: float = 0.05
    material_amount: float = 10.0
    material_tax: float = 2.0


def blocked_pairs(g: DataFrame, p: DataFrame, t: Near = Near()) -> DataFrame:
    """Pairs of a block (vendor, type) inside the date and amount windows, before any text is compared. Bins of dates and of amounts are keys of the join, so a large vendor is cut into cells."""
    money = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))
    cut = lambda df, s: df.select(F.upper(F.trim("vendor")).alias("v"), F.upper(F.trim("doc_type")).alias("t"), *(F.col(c).alias(f"{s}_{c}") for c in ("row_idx", "doc", "d", "rate")), *(money(c).alias(f"{s}_{c}") for c in MONEY))
    ensure_importable(g.sparkSession)
    side = lambda df, s, cut=cut: normalize.folded_alnum(materialize(cut(df, s), "near-side"), f"{s}_doc", f"{s}_norm")
    pairs = band_join(side(g, "g"), side(p, "p"), ["v", "t"], [Band("g_d", "p_d", t.days, date=True), Band("g_taxable", "p_taxable", t.amount, share=t.share)])
    return pairs.withColumn("days", normalize.days_apart(F.col("g_d"), F.col("p_d"))).withColumn("amount_diff", F.abs(F.col("g_taxable") - F.col("p_taxable")))


def scored(pairs: DataFrame, t: Near = Near()) -> DataFrame:
    """Candidates with features and score. Text similarity runs on pairs whose length bound allows the threshold."""
    pairs = pairs.where((similarity.upper_bound(F.col("g_norm"), F.col("p_norm")) >= t.invoice) | ((F.col("g_norm") == "") & (F.col("p_norm") == "")))
    pairs = pairs.withColumn("invoice", similarity.ratio(F.col("g_norm"), F.col("p_norm"))).where(F.col("invoice") >= t.invoice)
    diffs = {f"{h}_diff": F.abs(F.col(f"g_{h}") - F.col(f"p_{h}")) for h in HEADS}
    fit = lambda c, scale: F.greatest(F.lit(0.0), 1 - c.cast("double") / scale)
    tax = sum((fit(F.col(f"{h}_diff"), t.material_tax) for h in HEADS[1:]), fit(F.col("igst_diff"), t.material_tax)) / len(HEADS)
    rate = F.col("g_rate").eqNullSafe(F.col("p_rate")).cast("double")
    score = F.col("invoice") * 0.35 + fit(F.col("amount_diff"), t.material_amount) * 0.25 + tax * 0.20 + fit(F.col("days"), t.days) * 0.10 + rate * 0.05 + 0.05
    pairs = pairs.withColumns(diffs).withColumn("score", F.bround(score, 6)).withColumn("norm_equal", (F.col("g_norm") == F.col("p_norm")) & (F.col("g_norm") != ""))
    return pairs.where(F.col("score") >= t.least).select(F.col("g_row_idx").alias("g_idx"), F.col("p_row_idx").alias("p_idx"), "invoice", "norm_equal", "days", "amount_diff", *diffs, "score")


def ranked(candidates: DataFrame, t: Near = Near()) -> DataFrame:
    """Candidates with rank, gap and status: AMBIGUOUS, NEAR_MATCH_PROPOSED or MATERIAL_MISMATCH."""
    of_g, order = Window.partitionBy("g_idx"), Window.partitionBy("g_idx").orderBy(F.desc("score"), F.col("p_idx").cast("string"))
    c = candidates.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(of_g))
    top, second = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(of_g), F.max(F.when(F.col("rank") == 2, F.col("score"))).over(of_g)
    c = c.withColumn("second", second).withColumn("gap", F.when(F.col("n") > 1, top - second).otherwise(1.0))
    credible = F.count_if(F.col("score") >= t.proposal).over(of_g)
    ambiguous = (credible >= 2) | ((F.col("n") > 1) & (F.col("second") >= t.proposal - t.margin) & (F.col("gap") <= t.margin))
    of_p = Window.partitionBy("p_idx")
    best = F.max("score").over(of_p)
    c = c.withColumn("best", best)
    reciprocal = (F.col("score") == F.col("best")) & (F.count_if(F.col("score") == F.col("best")).over(of_p) == 1)
    agree = (F.col("amount_diff") <= t.material_amount) & (F.greatest(*(F.col(f"{h}_diff") for h in HEADS)) <= t.material_tax)
    c = c.withColumns({"ambiguous": ambiguous, "reciprocal": reciprocal, "agree": agree})
    proposed = ~F.col("ambiguous") & (F.col("rank") == 1) & (F.col("score") >= t.proposal) & F.col("agree") & F.col("reciprocal")
    status = F.when(F.col("ambiguous"), "AMBIGUOUS").when(proposed, "NEAR_MATCH_PROPOSED").otherwise("MATERIAL_MISMATCH")
    return c.withColumn("status", status).withColumn("gap", F.bround("gap", 6)).drop("second", "best", "n")


def outcomes(g: DataFrame, p: DataFrame, near: DataFrame, t: Near = Near()) -> tuple[DataFrame, DataFrame]:
    """(row_idx, outcome) of the rows that reached the near stage: NEAR, AMBIGUOUS, MISMATCH or G_ONLY; LINKED or P_ONLY."""
    per = near.groupBy("g_idx").agg(
        F.bool_or(F.col("status") == "AMBIGUOUS").alias("amb"), F.bool_or(F.col("status") == "NEAR_MATCH_PROPOSED").alias("prop"), F.bool_or(F.col("norm_equal") & ~F.col("agree")).alias("mat")
    )
    left = g.select("row_idx").join(per.withColumnRenamed("g_idx", "row_idx"), "row_idx", "left")
    left = left.select("row_idx", F.when(F.col("amb"), "AMBIGUOUS").when(F.col("prop"), "NEAR").when(F.col("mat"), "MISMATCH").otherwise("G_ONLY").alias("outcome"))
    linked = near.where(F.col("norm_equal") | (F.col("score") >= t.proposal - t.margin)).select(F.col("p_idx").alias("row_idx")).distinct().withColumn("is_linked", F.lit(True))
    right = p.select("row_idx").join(linked, "row_idx", "left").select("row_idx", F.when(F.col("is_linked"), "LINKED").otherwise("P_ONLY").alias("outcome"))
    return left, right


def reconcile(g: DataFrame, p: DataFrame, policy: Policy = Policy(), t: Near = Near()) -> DataFrame:
    """side, row_idx, outcome of every source row: exactly one each."""
    ensure_importable(g.sparkSession)
    one = materialize(exact(g, p), "exact", lean=True)
    g1, p1 = residual(g, one, "g_idx"), residual(p, one, "p_idx")
    two = materialize(tolerance(g1, p1, policy)[0], "tolerance", lean=True)
    g2, p2 = residual(g1, two, "g_idx"), residual(p1, two, "p_idx")
    near = materialize(ranked(scored(blocked_pairs(g2, p2, t), t), t), "near", lean=True)
    left, right = outcomes(g2, p2, near, t)
    taken = lambda m, s, name: m.select(F.col(s).alias("row_idx"), F.lit(name).alias("outcome"))
    left = left.unionByName(taken(one, "g_idx", "EXACT")).unionByName(taken(two, "g_idx", "TOLERANCE"))
    right = right.unionByName(taken(one, "p_idx", "EXACT")).unionByName(taken(two, "p_idx", "TOLERANCE"))
    return left.withColumn("side", F.lit("G")).unionByName(right.withColumn("side", F.lit("P"))).select("side", "row_idx", "outcome")
