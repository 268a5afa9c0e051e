"""Dual-ledger waterfall: exact, batches, one-to-one tolerance, tax heads, fuzzy documents, ambiguity, residuals.

Passes over blocks of one remaining P row are windows: such a block is consumed by its first G row that satisfies the pass, and a block with more P rows
can't shrink within a pass. The fuzzy pass has a fixed order of preference for each G row, so greedy.matched settles it. Batches and ambiguity, where the rows that are still free decide, run in row order
inside a vendor, whose rows are streamed to one function; batches look up amounts in order there and stop a sum that has grown too large, so a row costs a few comparisons, not one for each row of its vendor.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import normalize
from ledgerloom.functions.similarity import guarded, guarded_ratio
from ledgerloom.operators import greedy
from ledgerloom.operators.bands import Band, band_join
from ledgerloom.operators.ordered import in_groups
from ledgerloom.sources.session import ensure_importable
from ledgerloom.sources.store import materialize

LINK = "g_idx long, p_idx long, bucket string, sub string, share double"


@dataclass(frozen=True)
class Limits:
    """What the passes allow."""

    amount: float = 10.0
    days: int = 30
    ineligible: float = 100.0
    batch: float = 5.0
    cross_days: int = 60
    fuzzy: float = 0.85
    compete_amount: float = 25.0
    compete_text: float = 0.70


def prepare(df: DataFrame) -> DataFrame:
    """row_idx, v, n, d, taxable, tax and heads as the waterfall compares them; null amounts are 0."""
    money = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    v = F.upper(F.trim(F.coalesce("vendor", F.lit(""))))
    v = F.when(v.isin("NAN", "NONE", "NULL"), "").otherwise(v)
    heads = [money(h).alias(h) for h in ("igst", "cgst", "sgst")]
    return df.select("row_idx", v.alias("v"), normalize.doc_light(F.col("doc")).alias("n"), "d", money("taxable").alias("taxable"), *heads).withColumn("tax", F.col("igst") + F.col("cgst") + F.col("sgst"))


def together(g: DataFrame, p: DataFrame) -> DataFrame:
    """Rows of both prepared ledgers with their side."""
    return g.withColumn("side", F.lit("G")).unionByName(p.withColumn("side", F.lit("P")))


def in_blocks(rows: DataFrame, cases: list[Column]) -> DataFrame:
    """Rows of both sides with sub (null: left over) and, on G rows, the p_idx that they take.

    A block (vendor, document) with exactly one P row gives it to the first G row of the first case that any of its G rows has. Rows are dealt by block once: what a pass takes and what it leaves comes from the same windows,
    and later cases only see blocks whose P row is still free.
    """
    block = Window.partitionBy("v", "n")
    of_p = lambda c: F.max(F.when(F.col("side") == "P", F.col(c))).over(block)
    heads = ("igst", "cgst", "sgst")
    gap = lambda c: F.abs(F.col(c) - F.col(f"p_{c}"))
    some = (F.col("v") != "") | (F.col("n") != "")
    pairs = rows.where(some).withColumns({"of": F.count(F.when(F.col("side") == "P", 1)).over(block)} | {f"p_{c}": of_p(c) for c in ("row_idx", "d", "taxable", "tax", *heads)})
    any_head = F.greatest(*(F.col(c) for h in heads for c in (h, f"p_{h}"))) > 0
    pairs = pairs.withColumns({"t_diff": gap("taxable"), "x_diff": gap("tax"), "heads": any_head & (F.greatest(*map(gap, heads)) > 0.05)})
    names = [f"case{i}" for i in range(len(cases))]
    asking = (F.col("side") == "G") & (F.col("of") == 1)
    hits = pairs.withColumns({name: F.when(asking, case) for name, case in zip(names, cases)})
    hits = hits.withColumn("taker", F.coalesce(*(F.min(F.when(F.col(name).isNotNull(), F.col("row_idx"))).over(block) for name in names)))
    takes = (F.col("side") == "G") & (F.col("row_idx") == F.col("taker"))
    sub = F.when(takes, F.coalesce(*names)).when((F.col("side") == "P") & F.col("taker").isNotNull(), "TAKEN")
    done = hits.select(*rows.columns, F.when(takes, F.col("p_row_idx")).alias("p_idx"), sub.alias("sub"))
    return done.unionByName(rows.where(~some).select(*rows.columns, F.lit(None).cast("long").alias("p_idx"), F.lit(None).cast("string").alias("sub")))


def linked(rows: DataFrame) -> DataFrame:
    """The links of in_blocks()."""
    sub = F.col("sub")
    bucket = F.when(sub == "EXACT_1_TO_1", "EXACT_MATCH").when(sub == "INELIGIBLE_ITC_17_5", "INELIGIBLE").when(sub == "TAX_HEAD_INTERCHANGE", "NEAR_MATCH").otherwise("TOLERANCE_MATCH")
    return rows.where("side = 'G' AND sub IS NOT NULL").select(F.col("row_idx").alias("g_idx"), "p_idx", bucket.alias("bucket"), "sub", F.lit(100.0).alias("share"))


def unlinked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of G and P that in_blocks() leaves over."""
    return tuple(rows.where((F.col("side") == s) & F.col("sub").isNull()).drop("side", "p_idx", "sub") for s in "GP")


def exact_case() -> Column:
    days = F.when(F.col("d").isNotNull() & F.col("p_d").isNotNull(), normalize.days_apart(F.col("d"), F.col("p_d"))).when(F.col("d").eqNullSafe(F.col("p_d")), 0).otherwise(999)
    same = (F.col("t_diff") <= 0.05) & (F.col("x_diff") <= 0.05) & (days == 0) & ~F.col("heads")
    return F.when(same, "EXACT_1_TO_1")


def exact_pass(g: DataFrame, p: DataFrame) -> DataFrame:
    return linked(in_blocks(together(g, p), [exact_case()]))


def one_to_one_case(t: Limits) -> Column:
    """Blocked credit, year turn, date lag, small amounts: the first case that holds."""
    days = F.coalesce(normalize.days_apart(F.col("d"), F.col("p_d")), F.lit(0))
    cross = F.array_sort(F.array(F.month("d"), F.month("p_d"))) == F.array(F.lit(3), F.lit(4))
    over, plain = F.col("taxable") - F.col("p_taxable"), ~F.col("heads") & (F.col("t_diff") <= t.amount)
    return (
        F.when((over >= t.ineligible) & (F.col("p_taxable") > 0) & (F.col("tax") - F.col("p_tax") >= 0), "INELIGIBLE_ITC_17_5")
        .when(F.coalesce(cross, F.lit(False)) & (days <= t.cross_days) & (F.col("t_diff") <= t.amount), "CROSS_FY")
        .when((days > 0) & (days <= t.days) & plain, "DATE_PROXIMITY")
        .when((days == 0) & plain, "COMMERCIAL_TOLERANCE")
    )


def tax_head_case(t: Limits) -> Column:
    return F.when(F.col("heads") & (F.col("t_diff") <= t.amount) & (F.col("x_diff") <= 0.05), "TAX_HEAD_INTERCHANGE")


#: Rows up to which all sums of a pool are made at once.
FEW = 8


@cache
def combined(n: int, most: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All choices of two to `most` of n places, small ones first, and a row of zeros and ones for each."""
    choices = [c for k in range(2, min(n, most) + 1) for c in combinations(range(n), k)]
    return choices, np.array([[float(i in c) for i in range(n)] for c in choices])


def sums_near(amounts: list[float], most: int, goal: float, tol: float) -> list[tuple[int, ...]]:
    """Choices of two to `most` amounts whose sum may be within tol of goal, to be added up exactly: one product for all sums, a trifle wider than tol."""
    choices, picks = combined(len(amounts), most)
    return [choices[i] for i in (np.abs(picks @ np.array(amounts) - goal) <= tol + 1e-6 + 1e-12 * goal).nonzero()[0]]


class Pool:
    """Free rows (idx, doc, amount > 0) of one side of a vendor, in order of amount, so that a search looks at a few of them only."""

    def __init__(self, rows: list[tuple]):
        self.at = {r[0]: n for n, r in enumerate(rows)}  # places in row order
        self.rows = {n: r for n, r in enumerate(rows) if r[2] > 0}
        self.line = sorted((r[2], n) for n, r in self.rows.items())
        self.sums: np.ndarray | None = None

    def take(self, found: list[tuple]) -> None:
        for r in found:
            n = self.at[r[0]]
            if self.rows.pop(n, None) is not None:
                del self.line[bisect_left(self.line, (r[2], n))]
        self.sums = None

    def within(self, most: float) -> int:
        """How many rows have an amount up to most."""
        return bisect_right(self.line, (most, math.inf))

    def possible(self, n: int, goal: float, tol: float) -> bool:
        """False if no two or more of the n smallest amounts come near goal; more than FEW are not tried."""
        if n < 2 or self.line[0][0] + self.line[1][0] > goal + tol + 1e-6:
            return False
        return n > FEW or bool(sums_near([a for a, _ in self.line[:n]], n, goal, tol))

    def total(self, n: int) -> float:
        """Sum of the n smallest amounts."""
        if self.sums is None:
            self.sums = np.cumsum([0.0, *(a for a, _ in self.line)])
        return float(self.sums[n])

    def ordered(self, places: list[int]) -> list[tuple]:
        return [self.rows[n] for n in sorted(places)]

    def fitting(self, n: int, goal: float, tol: float, related: Callable[[str], bool]) -> list[tuple] | None:
        """The related ones among the n smallest amounts, or None as soon as these are too many to sum up to goal, or if all together are too few."""
        if self.total(n) < goal - tol - 1e-6 - 1e-9 * goal:
            return None
        found, total = [], 0.0
        for amount, place in reversed(self.line[:n]):
            if related(self.rows[place][1]):
                found.append(place)
                if (total := total + amount) > goal + tol + 1e-6:
                    return None
        return self.ordered(found)

    def nearest(self, n: int, goal: float, k: int) -> list[tuple]:
        """The k of the n smallest amounts that lie nearest to goal, ties in row order: from either side the first k of each run of equal amounts until k are together."""
        middle, found = min(n, bisect_left(self.line, (goal, -1))), []
        low, count = middle, 0
        while low > 0 and count < k:
            start = bisect_left(self.line, (self.line[low - 1][0], -1))
            found += self.line[start : min(low, start + k)]
            count, low = count + low - start, start
        high, count = middle, 0
        while high < n and count < k:
            end = min(n, bisect_right(self.line, (self.line[high][0], math.inf)))
            found += self.line[high : min(end, high + k)]
            count, high = count + end - high, end
        return [self.rows[place] for _, place in sorted(found, key=lambda x: (abs(x[0] - goal), x[1]))[:k]]


def many_to_one(pool: Pool, p: tuple, tol: float) -> list[tuple] | None:
    """G rows (idx, doc, amount) that sum up to a P row: all that are small enough, those with a related document, or a small combination."""
    n = pool.within(p[2] + tol)
    fits = lambda rows: len(rows) >= 2 and abs(sum(r[2] for r in rows) - p[2]) <= tol
    if not pool.possible(n, p[2], tol):
        return None
    if abs(pool.total(n) - p[2]) <= tol + 1e-6 and fits(every := pool.ordered([place for _, place in pool.line[:n]])):
        return every
    if p[1] and (related := pool.fitting(n, p[2], tol, lambda doc: p[1] in doc or doc in p[1] or guarded(p[1], doc) >= 0.6)) and fits(related):
        return related
    # part of the semantics: of more than eight the amounts nearest to a typical share
    few = pool.nearest(n, p[2] / 2.5, FEW) if n > FEW else pool.ordered([place for _, place in pool.line[:n]])
    near = sums_near([r[2] for r in few], 5, p[2], tol)
    return next((found for c in near if fits(found := [few[j] for j in c])), None)


def one_to_many(g: tuple, pool: Pool, tol: float) -> list[tuple] | None:
    """All related P rows, if they sum up to the G row."""
    n = pool.within(g[2] + tol)
    if not pool.possible(n, g[2], tol):
        return None
    related = pool.fitting(n, g[2], tol, lambda doc: g[1] in doc or doc in g[1] or guarded(g[1], doc) >= 0.7)
    return related if related and len(related) >= 2 and abs(sum(p[2] for p in related) - g[2]) <= tol else None


def sides(rows: list[tuple]) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """G and P rows (idx, doc, amount) of tuples (v, side, row_idx, n, taxable), by row_idx in the order given."""
    of = lambda s: {i: (i, n, t) for _, side, i, n, t in rows if side == s}
    return of("G"), of("P")


def both(g: DataFrame, p: DataFrame) -> DataFrame:
    """v, side, row_idx, n, taxable of both ledgers."""
    side = lambda df, s: df.select("v", F.lit(s).alias("side"), "row_idx", "n", "taxable")
    return side(g, "G").unionByName(side(p, "P"))


def batch_pass(g: DataFrame, p: DataFrame, t: Limits) -> DataFrame:
    """Batches of a vendor: first every P row as a sum of G rows, then every G row as a sum of P rows. A share is a part's percentage of the one row (N:1), or of the parts' sum (1:N)."""

    def run(rows: list[tuple]) -> list[tuple]:
        gs, ps = sides(rows)
        out: list[tuple] = []
        if not gs or not ps:
            return out
        pool = Pool(list(gs.values()))
        for i in list(ps):
            if (p_row := ps[i])[2] > 0 and (found := many_to_one(pool, p_row, t.batch)):
                out += [(r[0], i, "TOLERANCE_MATCH", "BATCH_N_TO_1", round(100 * r[2] / p_row[2], 1)) for r in found]
                del ps[i]
                pool.take(found)
                for r in found:
                    del gs[r[0]]
        if rows[0][0]:
            pool = Pool(list(ps.values()))
            for i, g_row in gs.items():
                if g_row[2] > 0 and (found := one_to_many(g_row, pool, t.batch)):
                    total = sum(r[2] for r in found)
                    out += [(i, r[0], "TOLERANCE_MATCH", "BATCH_1_TO_N", round(100 * r[2] / total, 1)) for r in found]
                    pool.take(found)
        return out

    return in_groups(both(g, p), ["v"], ["row_idx"], run, LINK, even=True)


def fuzzy_pass(g: DataFrame, p: DataFrame, t: Limits) -> DataFrame:
    """In row order each G row takes the free P row of its vendor with the most similar document, at a near amount; the first of equally similar ones.

    Candidates come from a join of amount bins inside a vendor, by classes of equal (vendor, document, amount); greedy.matched settles who gets which.
    """
    ensure_importable(g.sparkSession)
    asked = lambda df, row, name: greedy.classed(df.where("v != '' AND n != ''").select("v", "n", "taxable", "row_idx"), ["v", "n", "taxable"], row, name)
    (gs, g_rows), (ps, p_rows) = asked(g, "g_idx", "c"), asked(p, "p_idx", "q")
    side = lambda df, s: df.withColumnsRenamed({"n": f"{s}_n", "taxable": f"{s}_taxable"})
    pairs = band_join(side(gs, "g"), side(ps, "p"), ["v"], [Band("g_taxable", "p_taxable", t.amount)])
    pairs = pairs.withColumn("alike", guarded_ratio(F.col("g_n"), F.col("p_n"))).where(F.col("alike") >= t.fuzzy)
    links = greedy.matched(g_rows, pairs.select("c", "q", (-F.col("alike")).alias("place")), p_rows)
    return links.select("g_idx", "p_idx", F.lit("NEAR_MATCH").alias("bucket"), F.lit("DOC_PREFIX_NORMALIZED").alias("sub"), F.lit(100.0).alias("share"))


CLUSTER = "g_idx long, p_idx long, rank int, of int, invoice double, amount double, score double"


def ambiguity_clusters(g: DataFrame, p: DataFrame, t: Limits, most: int | None = 4) -> DataFrame:
    """G rows with two or more competing P rows, in row order of these: the first `most` by rank, how many compete (of), document and amount likeness and score. Each G row takes its first candidate away."""

    def run(rows: list[tuple]) -> list[tuple]:
        gs, ps = sides(rows)
        out: list[tuple] = []
        for i, doc, amount in gs.values():
            rivals = [j for j, other, value in ps.values() if abs(amount - value) <= t.compete_amount or (doc and other and 2 * min(len(doc), len(other)) / (len(doc) + len(other)) >= t.compete_text and guarded(doc, other) >= t.compete_text)]
            if len(rivals) < 2:
                continue
            for rank, j in enumerate(rivals[:most], 1):
                alike, apart = guarded(doc, ps[j][1]), abs(amount - ps[j][2])
                out.append((i, j, rank, len(rivals), round(100 * alike, 1), round(max(0.0, 100 - 4 * apart), 1), round(min(98.0, max(60.0, 50 * alike + max(0.0, 50 - apart))), 1)))
            del ps[rivals[0]]
        return out

    return in_groups(both(g, p).where("v != ''"), ["v"], ["row_idx"], run, CLUSTER, even=True)


def as_links(clusters: DataFrame) -> DataFrame:
    """The links of clusters: their first candidates; sub tells how many compete."""
    return clusters.where("rank = 1").select("g_idx", "p_idx", F.lit("AMBIGUOUS").alias("bucket"), F.concat(F.lit("COMPETING_"), "of").alias("sub"), F.lit(100.0).alias("share"))


def left_over(df: DataFrame, links: DataFrame, side: str) -> DataFrame:
    return df.join(links.select(F.col(side).alias("row_idx")).distinct(), "row_idx", "left_anti")


def passes(g: DataFrame, p: DataFrame, t: Limits = Limits(), batches: bool = True) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame]:
    """Links of all passes, what is left of prepared G and P, and the clusters of the ambiguity pass.

    Each pass works on what the ones before have left. Passes over blocks write their rows once, taken or left over; links of the other passes are written as tables.
    """
    rows = materialize(in_blocks(together(prepare(g), prepare(p)), [exact_case()]), "ledger", lean=True)
    done = [linked(rows)]
    g, p = unlinked(rows)

    def take(links: DataFrame) -> None:
        nonlocal g, p
        done.append(links)
        g, p = left_over(g, links, "g_idx"), left_over(p, links, "p_idx")

    if batches:
        take(materialize(batch_pass(g, p, t), "links", lean=True))
    rows = materialize(in_blocks(together(g, p), [one_to_one_case(t), tax_head_case(t)]), "ledger", lean=True)
    done.append(linked(rows))
    g, p = unlinked(rows)
    take(materialize(fuzzy_pass(g, p, t), "links", lean=True))
    clusters = materialize(ambiguity_clusters(g, p, t), "clusters", lean=True)
    take(as_links(clusters))
    return done, g, p, clusters


def waterfall(g: DataFrame, p: DataFrame, t: Limits = Limits(), batches: bool = True) -> DataFrame:
    """Links (g_idx, p_idx, bucket, sub, share) of all passes and, with a null side, the residual rows; batches: whether sums of rows are matched."""
    done, g, p, _ = passes(g, p, t, batches)
    blank = (F.col("v") == "") & (F.col("n") == "") & (F.col("taxable") <= 0)
    rest = lambda df, mine, other, name: df.select(F.col("row_idx").alias(mine), F.lit(None).cast("long").alias(other), F.lit(name).alias("bucket"), F.when(blank, "MALFORMED_BLANK_ROW").otherwise(name).alias("sub"), F.lit(None).cast("double").alias("share"))
    out = done[0]
    for links in (*done[1:], rest(g, "g_idx", "p_idx", "G_ONLY"), rest(p, "p_idx", "g_idx", "P_ONLY")):
        out = out.unionByName(links)
    return out


def dispositions(links: DataFrame) -> DataFrame:
    """side, row_idx, bucket, sub: one row for each source row."""
    side = lambda s, c: links.where(F.col(c).isNotNull()).select(F.lit(s).alias("side"), F.col(c).alias("row_idx"), "bucket", "sub").distinct()
    return side("G", "g_idx").unionByName(side("P", "p_idx"))
