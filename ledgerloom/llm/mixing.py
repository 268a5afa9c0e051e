"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a share of the mix, capped at MAX_REPEAT times the source. A target is met by whole copies of the source and, for
what remains, by one more copy of some of its documents. How many documents of each exact token length to add
is found on the histogram of lengths alone: a proportional part of every length, then a bounded knapsack by dynamic
programming over reachable sums for the last KNAPSACK tokens, with a few picks of each length given back first. Which documents of a length are added follows from a seeded hash of doc_id and text:
those up to the n-th smallest hash, found by counting hashes in BINS first, so that no large group is sorted whole. Of rows with the very n-th hash as many are taken as
are still wanted; these are equal rows, which are numbered by partition and place.

The plan has one row for each distinct length of a source. It is broadcast up to BROADCAST_ROWS rows; a larger one meets the documents in SALTS copies, so that a length that very many documents share is no single task.

Nulls and edge cases: a null text has size 0; documents of size 0 take nothing, but stand in the result; null is a source of its own, last in order;
repeated rows are documents each, and any of several equal rows may be the one that is taken; an empty table gives an empty result;
other columns are carried along whatever their names are, and size, source_size, target, copies and taken replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm._store import materialize
from ledgerloom.sources.session import ensure_importable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 20
KNAPSACK = 1 << 16
RELEASED = 4
BINS = 4096
BROADCAST_ROWS = 1 << 19
SALTS = 16
NEW = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def with_size(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), source, size, the source key _s (null apart from every string) and a seeded 63-bit hash _u."""
    return docs.select(
        F.struct(*(docs[c] for c in docs.columns if c not in NEW)).alias("row"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"),
        F.xxhash64(F.lit(SEED), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1)).alias("_u"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEAT) -> DataFrame:
    """_s, source_size, target: weights in source order, none above cap times its source, the excess reshared by weight.

    Filling by weight to one common level L gives min(cap, L * weight); sources run full in order of cap / weight.
    The windows see one row a source.
    """
    n = len(weights)
    per = sizes.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_n", F.row_number().over(order)).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % n + 1).cast("int")).cast("double"))
    per = per.withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_full", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_full", "_n")
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(Window.partitionBy()) * share - before) / F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", level).withColumn("_at", F.row_number().over(fill))
    found = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_at", "_level"))).over(Window.partitionBy())
    return per.withColumn("target", F.coalesce(F.least("_cap", found["_level"] * F.col("_w")), "_cap")).select("_s", "source_size", "target")


def fit_budget(size: np.ndarray, count: np.ndarray, target: float, cap: int = MAX_REPEAT) -> tuple[int, np.ndarray]:
    """Whole copies, and for each length how many documents get one more, so that the tokens come to target or as little below as can be."""
    size, count = [int(x) for x in size], [int(x) for x in count]
    total, goal = sum(s * c for s, c in zip(size, count)), int(target + 0.5)
    if not total:
        return 0, np.zeros(len(size), np.int64)
    copies = min(goal // total, cap)
    rest = goal - copies * total if copies < cap else 0
    pick = [rest * c // total if s else 0 for s, c in zip(size, count)]
    rest -= sum(s * p for s, p in zip(size, pick))
    # the largest fractions first, until the rest is small enough for the knapsack
    for i in sorted(range(len(size)), key=lambda i: (-(goal - copies * total) * count[i] % total, size[i])):
        if rest <= KNAPSACK:
            break
        if size[i] and pick[i] < count[i] and size[i] <= rest:
            pick[i] += 1
            rest -= size[i]
    # some picks go back, so that the knapsack has items of every length to choose from
    for i in sorted(range(len(size)), key=lambda i: size[i]):
        back = min(pick[i], RELEASED)
        if rest + size[i] * back <= KNAPSACK:
            pick[i] -= back
            rest += size[i] * back
    # bounded knapsack: reach holds the sums made so far as bits; first[s] is the item that first made s
    reach, mask, first = 1, (1 << (rest + 1)) - 1, {}
    items: list[tuple[int, int]] = []
    for i in sorted(range(len(size)), key=lambda i: size[i]):
        left, unit = count[i] - pick[i], 1
        while size[i] and left and size[i] * unit <= rest:
            unit = min(unit, left)
            items.append((i, unit))
            left, unit = left - unit, unit * 2
    for k, (i, unit) in enumerate(items):
        if reach >> rest & 1:
            break
        new = (reach << size[i] * unit) & mask & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
            first.update(dict.fromkeys(np.flatnonzero(bits).tolist(), k))
            reach |= new
    at = reach.bit_length() - 1
    while at:
        i, unit = items[first[at]]
        pick[i] += unit
        at -= size[i] * unit
    return copies, np.array(pick, np.int64)


def met(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with a written table that has one row for each key: broadcast if its counted size allows, else in salted copies."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), by)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(copies, [*by, "_salt"]).drop("_salt")


def plan(sizes: DataFrame, per_source: DataFrame, cap: int = MAX_REPEAT) -> DataFrame:
    """_s, size, _c, _cut, _spare, _tied: every document of the length takes _c copies, one more where its hash is below _cut, and so do _spare of the _tied rows whose hash is _cut."""
    ensure_importable(sizes.sparkSession)
    histogram = sizes.groupBy("_s", "size").agg(F.count("*").alias("n")).join(F.broadcast(per_source), "_s")  # one row a source

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        copies, pick = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), cap)
        return pdf.assign(_c=copies, pick=pick)[["_s", "size", "_c", "pick"]]

    # a group has one row for each distinct length of its source, however many documents that is
    picks = materialize(histogram.groupBy("_s").applyInPandas(fitted, "_s string, size long, _c int, pick long"), "mix-picks", lean=True)
    shift = 63 - (BINS.bit_length() - 1)
    hashed = sizes.select("_s", "size", "_u", F.shiftright("_u", shift).alias("_bin"))
    upto = F.sum("n").over(Window.partitionBy("_s", "size").orderBy("_bin"))
    bins = hashed.groupBy("_s", "size", "_bin").agg(F.count("*").alias("n")).withColumn("_upto", upto)
    last = bins.join(picks.where("pick > 0"), ["_s", "size"]).where("_upto >= pick and _upto - n < pick").select("_s", "size", "_bin", (F.col("pick") - F.col("_upto") + F.col("n")).alias("_nth"))
    last = materialize(last, "mix-bins", lean=True)
    # equal hashes are counted before the window sees them
    tied = met(hashed, last, ["_s", "size", "_bin"]).groupBy("_s", "size", "_u", "_nth").agg(F.count("*").alias("_tied"))
    upto = F.sum("_tied").over(Window.partitionBy("_s", "size").orderBy("_u"))
    cut = tied.withColumn("_upto", upto).where("_upto >= _nth and _upto - _tied < _nth").select("_s", "size", F.col("_u").alias("_cut"), (F.col("_nth") - F.col("_upto") + F.col("_tied")).alias("_spare"), "_tied")
    none = {"_cut": -1, "_spare": 0, "_tied": 0}
    return materialize(picks.drop("pick").join(cut, ["_s", "size"], "left").fillna(none), "mix-plan", lean=True)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _r: 1, 2, ... within (_s, size), counted by partition first, so that no group comes to one task."""
    placed = materialize(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "mix-tied")
    of = ["_s", "size", "_part"]
    before = Window.partitionBy("_s", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = placed.groupBy(*of).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*of).orderBy("_at"))
    return placed.withColumn("_r", nth).join(counts, of).withColumn("_r", F.col("_r") + F.col("_before")).drop("_at", "_part", "_n", "_before")


def apply_plan(sized: DataFrame, chosen: DataFrame, per_source: DataFrame) -> DataFrame:
    """The columns of the rows of sized with size, source_size, target, copies (how often the mix takes the document) and taken (its tokens in the mix)."""
    both = met(sized, chosen, ["_s", "size"])
    more = (F.col("_u") < F.col("_cut")) | ((F.col("_u") == F.col("_cut")) & (F.col("_spare") >= F.col("_tied")))
    if not chosen.where("_spare < _tied").isEmpty():
        split = (F.col("_u") == F.col("_cut")) & (F.col("_spare") < F.col("_tied"))
        equal = numbered(both.where(split)).withColumn("_more", F.col("_r") <= F.col("_spare")).drop("_r")
        both = both.where(~split).withColumn("_more", more).unionByName(equal)
    else:
        both = both.withColumn("_more", more)
    out = both.join(F.broadcast(per_source), "_s").withColumn("copies", F.col("_c") + F.col("_more").cast("int"))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEAT) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies and taken."""
    sized = with_size(docs)
    lean = materialize(sized.select("_s", "source", "size", "_u"), "mix-sizes")
    per_source = materialize(targets(lean, weights, share, cap), "mix-targets", lean=True)
    return apply_plan(sized, plan(lean, per_source, cap), per_source)
