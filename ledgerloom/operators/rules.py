"""Matching by rules that are data: one row of G with one row of P, tier after tier, and in four passes with quarantine of what is ambiguous.

Text rules and guards are equalities, number and date rules are bands; a join of these makes candidates (bands.band_join). A match takes its P row away from later G rows: where a row takes the first
free candidate, rows that can compete are read in order or settled in rounds (greedy.matched); where it matters how many are free, rows that can compete are found as connected components, and each component is read in row order.
"""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ledgerloom.functions import normalize
from ledgerloom.functions.similarity import guarded, guarded_ratio
from ledgerloom.operators import greedy, scan
from ledgerloom.operators.bands import Band, band_join
from ledgerloom.operators.ordered import in_groups
from ledgerloom.operators.reach import Near, first_in_reach
from ledgerloom.sources.session import ensure_importable
from ledgerloom.sources.store import materialize

PLAIN = ("TRIM_WHITESPACE", "UPPERCASE")
FULL = ("TRIM_WHITESPACE", "UPPERCASE", "REMOVE_PREFIXES", "ALPHANUMERIC_ONLY", "TRIM_LEADING_ZEROS")
EQUALITIES = ("text", "guard")
#: Distinct values of a segment of range_yield().
SEGMENT = 200_000


@dataclass(frozen=True)
class Rule:
    """kind: text (equal after steps), guard (equal, trimmed and upper-case), number or date (within the tolerance)."""

    name: str
    column: str
    kind: str
    tolerance: float = 0.0
    percent: bool = False
    unit: str = "DAYS"
    steps: tuple[str, ...] = ()

    def value(self) -> Column:
        c = F.col(self.column)
        if self.kind == "text":
            return normalize.chain(c.cast("string"), list(self.steps))
        if self.kind == "guard":
            return F.nullif(F.upper(F.trim(c.cast("string"))), F.lit(""))
        return c.cast("date") if self.kind == "date" else normalize.number(c)

    def same(self) -> tuple:
        """Rules with the same of this have the same value()."""
        return self.column, self.kind, self.steps

    def days(self) -> int:
        return normalize.in_days(self.tolerance, self.unit)

    def allowed(self, value: float) -> float:
        return abs(value * self.tolerance / 100) if self.percent else self.tolerance


VENDOR, DOC = Rule("vendor", "vendor", "text", steps=PLAIN), Rule("document", "doc", "text", steps=FULL)
AMOUNT, DAY = Rule("amount", "taxable", "number", 10.0), Rule("date", "d", "date", 30)
#: The rules of the four passes, and three tiers that loosen step by step.
DEFAULT = (VENDOR, DOC, AMOUNT, DAY)
TIERS = {
    "Tier 1: Strict": (VENDOR, replace(DOC, steps=PLAIN), replace(AMOUNT, tolerance=0.0), replace(DAY, tolerance=0)),
    "Tier 2: Normalized": (VENDOR, DOC, replace(AMOUNT, tolerance=0.0), replace(DAY, tolerance=0)),
    "Tier 3: Tolerance": DEFAULT,
}


def sided(g: DataFrame, p: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """side, row_idx and columns of both ledgers."""
    of = lambda df, s: df.select(F.lit(s).alias("side"), "row_idx", *(c.alias(n) for n, c in columns.items()))
    return of(g, "G").unionByName(of(p, "P"))


def simulate(g: DataFrame, p: DataFrame, rules: tuple[Rule, ...], of: dict[tuple, str] | None = None) -> DataFrame:
    """g_idx, p_idx: in row order each G row takes the first free P row that passes all rules. of: columns that hold the rules' values already, by Rule.same().

    Candidates are made by a join: equalities are keys, the first two number or date rules with absolute tolerances are bands. Rows with equal values under all rules are one class there. Without any equality or
    such band there is nothing to join on, and an error is raised. Without any equality all rows near each other can compete, so with a number rule they are dealt by ranges of it (reach.first_in_reach) and no pairs are made.
    """
    names = {f"v{i}": r for i, r in enumerate(rules)}
    equal = [n for n, r in names.items() if r.kind in EQUALITIES]
    rest = {n: r for n, r in names.items() if r.kind not in EQUALITIES}
    bands = [Band(f"g_{n}", f"p_{n}", r.days(), date=True) if r.kind == "date" else Band(f"g_{n}", f"p_{n}", r.tolerance + 1e-4) for n, r in rest.items() if r.kind == "date" or not r.percent]
    if not equal and not bands:
        raise ValueError("a text rule, or a condition with an absolute tolerance, is needed to join on")
    values = lambda df: df.select("row_idx", *((r.value() if of is None else F.col(of[r.same()])).alias(n) for n, r in names.items()))
    if not equal and (lead := next((n for n, r in rest.items() if r.kind == "number" and not r.percent), None)):
        order = {lead: rest[lead], **rest}
        nears = [Near(r.days()) if r.kind == "date" else Near(1e-4, r.tolerance) if r.percent else Near(r.tolerance + 1e-4) for r in order.values()]
        numbers = lambda df: values(df).select("row_idx", *(Band(n, n, 0, date=r.kind == "date").number(n).alias(f"x{i}") for i, (n, r) in enumerate(order.items())))
        if (links := first_in_reach(numbers(g), numbers(p), nears)) is not None:
            return links
    (gs, g_rows), (ps, p_rows) = greedy.classed(values(g), list(names), "g_idx", "c"), greedy.classed(values(p), list(names), "p_idx", "q")
    side = lambda df, s: df.withColumnsRenamed({n: f"{s}_{n}" for n in rest})
    pairs = band_join(side(gs, "g"), side(ps, "p"), equal, bands)
    for n, r in rest.items():
        if r.kind == "number" and r.percent:
            pairs = pairs.where(F.abs(F.col(f"g_{n}") - F.col(f"p_{n}")) <= F.abs(F.col(f"g_{n}") * r.tolerance / 100) + 1e-4)
    return greedy.matched(g_rows, pairs.select("c", "q", F.lit(0.0).alias("place")), p_rows)


def tiered(g: DataFrame, p: DataFrame, tiers: dict[str, tuple[Rule, ...]] = TIERS) -> DataFrame:
    """g_idx, p_idx, tier: each tier matches what the ones before have left."""
    values = {r.same(): r.value() for rules in tiers.values() for r in rules}  # tiers that differ in tolerances share them
    of = {k: f"c{i}" for i, k in enumerate(values)}
    g, p = (materialize(df.select("row_idx", *(v.alias(of[k]) for k, v in values.items())), "tiered") for df in (g, p))
    out = None
    for name, rules in tiers.items():
        links = materialize(simulate(g, p, rules, of), "tier", lean=True)
        g, p = (df.join(links.select(F.col(c).alias("row_idx")), "row_idx", "left_anti") for df, c in ((g, "g_idx"), (p, "p_idx")))
        links = links.withColumn("tier", F.lit(name))
        out = links if out is None else out.unionByName(links)
    return out


def tier_yields(links: DataFrame, g: DataFrame) -> DataFrame:
    """Per tier: matches, the G tax in them, running matches and how much of G is matched up to there in percent."""
    tax = (F.col("igst") + F.col("cgst") + F.col("sgst")).cast("decimal(18,2)")
    rows = g.select(F.col("row_idx").alias("g_idx"), tax.alias("tax"))
    per = rows.join(links, "g_idx", "left").groupBy("tier").agg(F.count("*").alias("n"), F.sum("tax").cast("double").alias("tax"))
    total = F.sum("n").over(Window.partitionBy())  # one row a tier
    running = F.sum("n").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("total", total).where("tier is not null").withColumn("running", running)
    return per.select("tier", "n", "tax", "running", F.round(100.0 * F.col("running") / F.col("total"), 1).cast("double").alias("percent"))


def rule_yield(g: DataFrame, p: DataFrame, rule: Rule) -> DataFrame:
    """One row: how many pairs a rule alone could make. Equalities: values in common, counted with repeats; numbers and dates: both sides in order, each G value with the first free P value in reach."""
    if rule.kind in EQUALITIES:
        count = lambda df, n: df.select(rule.value().alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias(n))
        pairs = count(g, "a").join(count(p, "b"), "v").agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("pairs"))
    else:
        pairs = range_yield(g, p, rule)
    return pairs.select(F.lit(rule.name).alias("rule"), "pairs")


def range_yield(g: DataFrame, p: DataFrame, rule: Rule) -> DataFrame:
    """One row, pairs: how many pairs two pointers make that run over both sides in order, each G value with the first free P value in reach.

    These pairs are a largest matching of values within the tolerance, so they are all G rows but the largest lack: the most by which G rows of some intervals outnumber the P rows in reach of them. Along the line, an interval
    of reach that begins at s and ends at e adds U(e) + V(s), where U counts G values up to e - tolerance less P values up to e, and V the same from below s with the other sign. The best set of
    intervals is a walk between the states "outside" and "inside"; a segment of the line makes it a 2 x 2 table of best gains, and tables compose. So segments of distinct values are reduced each in its own task, and
    the driver folds one table a segment. Numbers count to six decimals. Rows are counted by what stands in the column, and only the distinct values are read as numbers and moved.
    """
    tol = F.lit(rule.days() if rule.kind == "date" else rule.tolerance).cast("decimal(30,6)")
    at = (F.datediff(rule.value(), F.lit(dt.date(1970, 1, 1))) if rule.kind == "date" else rule.value()).cast("decimal(30,6)")
    counted = lambda df, label: materialize(df.groupBy(rule.column).agg(F.count("*").alias("_n")).select(at.alias("at"), "_n").where("at IS NOT NULL"), label)
    g, p = counted(g, "g_values"), counted(p, "p_values")
    point = lambda df, *steps: df.select(F.explode(F.array(*(F.struct((F.col("at") + shift).cast("decimal(30,6)").alias("at"), (u * F.col("_n")).alias("u"), (v * F.col("_n")).alias("v")) for shift, u, v in steps))).alias("x")).select("x.*")
    zero = F.lit(0).cast("decimal(30,6)")
    points = point(g, (tol, 1, 0), (-tol, 0, -1)).unionByName(point(p, (zero, -1, 1))).groupBy("at").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    points = materialize(points, "points")
    n = max(1, -(-points.count() // SEGMENT))
    dealt = materialize(points.repartitionByRange(n, "at").withColumn("segment", F.spark_partition_id()), "segments")
    offsets, u, v = {}, 0, 0
    for row in dealt.groupBy("segment").agg(F.sum("u").alias("u"), F.sum("v").alias("v")).orderBy("segment").collect():  # a row a segment
        offsets[row.segment] = (u, v)
        u, v = u + row.u, v + row.v

    def table(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        segment = key[0].as_py()
        rows = rows.sort_by("at")
        u, v = offsets[segment]
        best = {"out": [0, -math.inf], "in": [-math.inf, 0]}  # by the state at the start: best gain outside and inside so far
        for du, dv in zip(rows["u"].to_pylist(), rows["v"].to_pylist()):
            for b in best.values():
                b[1] = max(b[1], b[0] + v)  # an interval begins before what stands here
            u, v = u + du, v + dv
            for b in best.values():
                b[0] = max(b[0], b[1] + u)  # or ends behind it
        return pa.table({"segment": [segment], "oo": [best["out"][0]], "oi": [best["out"][1]], "io": [best["in"][0]], "ii": [best["in"][1]]}, schema=pa.schema([("segment", pa.int32()), *((c, pa.float64()) for c in ("oo", "oi", "io", "ii"))]))

    ensure_importable(g.sparkSession)
    out, inside = 0.0, -math.inf
    for t in dealt.groupBy("segment").applyInArrow(table, "segment int, oo double, oi double, io double, ii double").orderBy("segment").collect():  # a row a segment
        out, inside = max(out + t.oo, inside + t.io), max(out + t.oi, inside + t.ii)
    return g.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.lit(int(out))).alias("pairs"))


PASSES = "g_idx long, p_idx long, pass int, bucket string, rank int, score double"


def days_between(a: dt.date | None, b: dt.date | None) -> int:
    """0 if one is missing."""
    return abs((a - b).days) if a and b else 0


def related(a: str, b: str) -> bool:
    """Whether two normalised documents are equal, contain each other or are similar."""
    return a == b or (len(a) >= 3 and a in b) or (len(b) >= 3 and b in a) or guarded(a, b) >= 0.85


@pandas_udf(T.BooleanType())
def related_documents(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([related(x, y) for x, y in zip(a, b)], dtype="bool")


@pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series, at: pd.Series, bt: pd.Series, days: pd.Series, ax: pd.Series, bx: pd.Series) -> pd.Series:
    """Score of an ambiguous candidate from documents, amounts, days and taxes."""
    fit = lambda x, y: max(0.0, 1 - abs(x - y) / max(x, 1.0))
    return pd.Series(
        [round((0.40 * (guarded(n, m) if n and m else 0.5) + 0.30 * fit(t, u) + 0.15 * max(0.0, 1 - d / 60) + 0.15 * fit(x, y)) * 100, 1) for n, m, t, u, d, x, y in zip(a, b, at, bt, days, ax, bx)], dtype="float64"
    )


def competing(rows: DataFrame, others: dict[str, Rule]) -> DataFrame:
    """node, component of the rows of four_passes() that can compete: they share a document by rule or as written, or are near each other in the third pass.

    Rows of one document are tied to the smallest of them, so a document with many rows makes as many edges as rows. Near rows come from a band join on the first two number rules; without a number rule, all rows of a vendor are one component.
    """
    numbers = {n: r for n, r in others.items() if r.kind == "number"}

    def tied(*key: str) -> DataFrame:
        # keys by hash: keys that share one would tie rows that can't compete, which makes a component larger and changes nothing else
        some = rows.where(" AND ".join(f"{c} != ''" for c in key) or "true").select("node", "side", F.xxhash64("v", *key[1:]).alias("k"))
        first = some.groupBy("k").agg(F.min("node").alias("b"), F.count_if(F.col("side") == "G").alias("gs"), F.count_if(F.col("side") == "P").alias("ps")).where("gs > 0 AND ps > 0")
        return some.join(first, "k").select(F.col("node").alias("a"), "b")

    edges = tied("v", "n").unionByName(tied("v", "clean"))
    if not numbers:
        return greedy.components(edges.unionByName(tied()))
    side = lambda s: rows.where(F.col("side") == s).select("v", F.col("node").alias("ab"["GP".index(s)]), *(F.col(c).alias(f"{s}_{c}") for c in ("n", *others)))
    near = band_join(side("G"), side("P"), ["v"], [Band(f"G_{n}", f"P_{n}", max(2 * r.tolerance, 50)) for n, r in numbers.items()])
    for n, r in others.items():
        if r.kind == "date":
            near = near.where(F.coalesce(normalize.days_apart(F.col(f"G_{n}"), F.col(f"P_{n}")), F.lit(0)) <= max(int(r.tolerance), 45))
        elif r.kind in EQUALITIES:
            near = near.where((F.col(f"G_{n}") == F.col(f"P_{n}")) & (F.col(f"G_{n}") != ""))
    near = near.where(related_documents("G_n", "P_n")).select("a", "b")
    return greedy.components(edges.unionByName(near))


def four_passes(g: DataFrame, p: DataFrame, rules: tuple[Rule, ...] = DEFAULT) -> DataFrame:
    """Links (PASSES) of a vendor rule, a document rule and more: 1 exact, 2 tolerance, 3 near document, 4 ambiguous with ranked candidates, and 5 the residuals of both sides.

    Exact: the first free P row of vendor and document that agrees on all rules. Tolerance: the only one within all tolerances (documents by rule, else upper-case with single blanks); near: the only
    one of the vendor with a similar or contained document and looser limits. Several make a collision: it keeps what is still free after pass 3, if two or more are. Rows without a candidate left then get the three
    nearest amounts of the vendor, if it has two. An ambiguous row takes no P row away, so its candidates are residuals, too.

    The first three passes are read in row order inside connected components of competing rows; a vendor, however large, is many of these. The fourth is joins and neighbours in order of amount.
    """
    ensure_importable(g.sparkSession)
    vendor, doc = (next(r for r in rules if r.name == n) for n in ("vendor", "document"))
    others = {f"v{i}": r for i, r in enumerate(r for r in rules if r.name not in ("vendor", "document"))}
    clean = F.regexp_replace(F.trim(F.upper(F.coalesce(doc.column, F.lit("")))), r"\s+", " ")
    tax = sum((F.coalesce(F.col(h).cast("double"), F.lit(0.0)) for h in ("cgst", "sgst")), F.coalesce(F.col("igst").cast("double"), F.lit(0.0)))
    values = {n: F.coalesce(r.value(), F.lit(0.0)) if r.kind == "number" else r.value() for n, r in others.items()}
    columns = {"v": F.coalesce(vendor.value(), F.lit("")), "n": F.coalesce(doc.value(), F.lit("")), "clean": clean, "t": F.coalesce(F.col("taxable").cast("double"), F.lit(0.0)), "x": tax, "d": F.col("d"), **values}
    rows = materialize(sided(g, p, columns).withColumn("node", 2 * F.col("row_idx") + (F.col("side") == "P").cast("long")), "passes")
    sent = rows.join(competing(rows, others), "node").select("component", "side", "row_idx", "v", "n", "clean", *others)
    at = [(sent.columns.index(n), r) for n, r in others.items()]
    SIDE, IDX, V, N, CLEAN = range(1, 6)

    def agree(a: tuple, b: tuple, number: Callable, date: Callable) -> bool:
        return all(number(r, a[i], b[i]) if r.kind == "number" else date(r, a[i], b[i]) if r.kind == "date" else bool(a[i]) and a[i] == b[i] for i, r in at)

    exact = lambda a, b: a[N] == b[N] and agree(a, b, lambda r, x, y: abs(x - y) <= 0.05, lambda r, x, y: x is not None and x == y)
    tolerant = lambda a, b: agree(a, b, lambda r, x, y: abs(x - y) <= r.allowed(x) + 1e-3, lambda r, x, y: days_between(x, y) <= r.days())
    near = lambda a, b: a[V] == b[V] and agree(a, b, lambda r, x, y: abs(x - y) <= max(2 * r.tolerance, 50), lambda r, x, y: days_between(x, y) <= max(int(r.tolerance), 45)) and related(a[N], b[N])

    def run(block: list[tuple]) -> list[tuple]:
        gs, ps = ({x[IDX]: x for x in block if x[SIDE] == s} for s in "GP")
        by_doc, by_clean, out = defaultdict(list), defaultdict(list), []
        for j, y in ps.items():
            if y[V] and y[N]:
                by_doc[y[V], y[N]].append(j)
            if y[V] and y[CLEAN]:
                by_clean[y[V], y[CLEAN]].append(j)
        free = dict(ps)
        of = lambda a, index, key: [j for j in index.get((a[V], key), ()) if j in free] if a[V] else []

        def link(i: int, j: int, nth: int) -> None:
            out.append((i, j, nth))
            del free[j], gs[i]

        for i, a in list(gs.items()):
            if (j := next((j for j in of(a, by_doc, a[N]) if exact(a, free[j])), None)) is not None:
                link(i, j, 1)
        collisions: dict[int, list[int]] = {}
        for i, a in list(gs.items()):
            found = [j for j in of(a, by_doc, a[N]) or (of(a, by_clean, a[CLEAN]) if a[CLEAN] else []) if tolerant(a, free[j])]
            if len(found) == 1:
                link(i, found[0], 2)
            elif found:
                collisions[i] = found
        for i, a in list(gs.items()):
            if i not in collisions:
                found = [j for j, b in free.items() if near(a, b)]
                if len(found) == 1:
                    link(i, found[0], 3)
                elif found:
                    collisions[i] = found
        return out + [(i, j, 0) for i, found in collisions.items() for j in found]

    done = materialize(in_groups(sent, ["component"], ["row_idx"], run, "g_idx long, p_idx long, pass int"), "passes", lean=True)
    buckets = F.when(F.col("pass") == 1, "EXACT_MATCH").when(F.col("pass") == 2, "TOLERANCE_MATCH").otherwise("NEAR_MATCH")
    links = done.where("pass > 0").select("g_idx", "p_idx", "pass", buckets.alias("bucket"), F.lit(1).alias("rank"), F.lit(100.0).alias("score"))
    rest = lambda s, c: rows.where(F.col("side") == s).withColumnRenamed("row_idx", c).join(links.select(c), c, "left_anti")
    open_g, free = materialize(rest("G", "g_idx"), "open"), materialize(rest("P", "p_idx"), "free")
    collided = done.where("pass = 0").select("g_idx", "p_idx")
    alone = open_g.join(collided, "g_idx", "left_anti")
    near_by = scan.nearest(alone.select("v", F.col("g_idx").alias("row"), F.col("t").alias("at")), free.select("v", F.col("p_idx").alias("item"), F.col("t").alias("at")), ["v"], 3)
    pairs = collided.join(free.select("p_idx"), "p_idx", "left_semi").select("g_idx", "p_idx", F.lit(0).alias("nth")).unionByName(near_by.select(F.col("row").alias("g_idx"), F.col("item").alias("p_idx"), F.col("rank").alias("nth")))
    several = pairs.join(pairs.groupBy("g_idx").agg(F.count("*").alias("k")).where("k >= 2"), "g_idx")
    side = lambda df, c, s: df.select(c, *(F.col(x).alias(f"{s}_{x}") for x in ("n", "t", "d", "x")))
    several = several.join(side(open_g, "g_idx", "g"), "g_idx").join(side(free, "p_idx", "p"), "p_idx")
    days = F.coalesce(normalize.days_apart(F.col("g_d"), F.col("p_d")), F.lit(0))
    several = several.withColumn("score", likeness("g_n", "p_n", "g_t", "p_t", days, "g_x", "p_x"))
    rank = F.row_number().over(Window.partitionBy("g_idx").orderBy(F.desc("score"), "nth", "p_idx"))
    ambiguous = materialize(several.select("g_idx", "p_idx", F.lit(4).alias("pass"), F.lit("AMBIGUOUS").alias("bucket"), rank.alias("rank"), "score"), "ambiguous", lean=True)
    left = lambda df, mine, other, name: df.select(F.col(mine), F.lit(None).cast("long").alias(other), F.lit(5).alias("pass"), F.lit(name).alias("bucket"), F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"))
    return links.unionByName(ambiguous).unionByName(left(open_g.join(ambiguous.select("g_idx"), "g_idx", "left_anti"), "g_idx", "p_idx", "GSTR_ONLY")).unionByName(left(free, "p_idx", "g_idx", "PR_ONLY"))


def resolve(pairs: DataFrame) -> DataFrame:
    """Pairs (g_doc, p_doc, g_taxable, p_taxable, g_date, p_date, accepted) that a reviewer has decided, with the bucket that the passes would give them; a rejected one is GSTR_ONLY."""
    norm = lambda c: normalize.strip_zeros(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")))
    a, b = norm("g_doc"), norm("p_doc")
    diff = F.round(F.abs(F.col("g_taxable") - F.col("p_taxable")), 2)
    days = F.coalesce(normalize.days_apart(F.col("g_date"), F.col("p_date")), F.lit(0))
    same = (a == b) & (a != "")
    inside = ((F.length(a) >= 3) & F.contains(b, a)) | ((F.length(b) >= 3) & F.contains(a, b))
    alike = same | inside | (guarded_ratio(a, b) >= 0.95)
    bucket = F.when(~F.col("accepted"), "GSTR_ONLY").when(same & (diff <= 0.05) & (days == 0), "EXACT_MATCH").when(alike & (diff <= 10) & (days <= 30), "TOLERANCE_MATCH").otherwise("NEAR_MATCH")
    return pairs.withColumn("bucket", bucket)
