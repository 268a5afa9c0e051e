"""First come within reach: "in row order each G row takes the first free P row whose numbers are near", without a list of all near pairs.

Rows are dealt by ranges of one number, a P row to every range that has G rows in its reach, and each range is settled in its task. There G rows ask for the first P row that holds no smaller G row, and a P row keeps the smallest that asks.
A P row near a border may be asked for from both sides: the smallest holds it, and the others ask on in the next round, where only ranges with such rows are read, by turns around the borders and between them.
What asks in which round doesn't change the outcome (deferred acceptance, see greedy). Candidates are looked up a few thousand rows at a time and dropped again, so memory holds the rows of a range, and no more rows are written than there are links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.sources.session import ensure_importable
from ledgerloom.sources.store import materialize, remove

#: Rows of a range, about, and of one where many stand close together at most; candidates that are looked up at once.
RANGE, CROWD = 200_000, 2_000_000
AT_ONCE = 1_000_000
#: A range is as wide as so many reaches at least, and what is read around a border goes as far on either side.
WIDTH, AROUND = 8, 32
NOBODY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Near:
    """Numbers of G and P of which the absolute difference is at most reach, or share of the G number and reach."""

    reach: float
    share: float = 0.0

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.abs(x * self.share / 100) + self.reach if self.share else np.full(len(x), self.reach)


def wider(x: np.ndarray, reach: float) -> np.ndarray:
    """A little more than reach: what is found with it is compared exactly afterwards."""
    return reach + 1e-6 + 1e-9 * np.abs(x)


class Side:
    """The P rows of a range, so placed that the ones within two reaches of a G row are a few stretches."""

    def __init__(self, xs: list[np.ndarray], nears: list[Near]):
        self.xs, self.nears = xs, nears
        # the line makes one dimension of a grid, the first other number with a fixed reach the second
        self.second = next((i for i, n in enumerate(nears) if i and not n.share), None)
        self.line = np.sort(xs[0])
        rank = np.searchsorted(self.line, xs[0])
        self.bins, at = np.unique(self.bin(xs), return_inverse=True)
        key = at * (len(rank) + 1) + rank
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def bin(self, xs: list[np.ndarray]) -> np.ndarray:
        return np.zeros(len(xs[0])) if self.second is None else np.floor(xs[self.second] / (max(self.nears[self.second].reach, 1e-6) * (1 + 1e-9)))

    def stretches(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """From and to for each G row and each of the bins around its own."""
        wide = wider(xs[0], self.nears[0].reach)
        low, high = np.searchsorted(self.line, xs[0] - wide), np.searchsorted(self.line, xs[0] + wide, "right")
        mine, found = self.bin(xs), []
        for step in (0,) if self.second is None else (-1, 0, 1):
            at = np.searchsorted(self.bins, mine + step)
            there = self.bins[np.minimum(at, len(self.bins) - 1)] == mine + step
            first = np.searchsorted(self.key, at * (len(self.line) + 1) + low)
            found.append((first, np.where(there, np.searchsorted(self.key, at * (len(self.line) + 1) + high), first)))
        return np.stack([f for f, _ in found], 1), np.stack([t for _, t in found], 1)

    def candidates(self, xs: list[np.ndarray]) -> Iterator[tuple[int, list[list[int]]]]:
        """Number of the first of some G rows, and the P rows in reach of each of them in row order (P rows are numbered in that order)."""
        if not len(self.line):
            return
        first, last = self.stretches(xs)
        many = np.maximum(last - first, 0)
        upto = np.cumsum(many.sum(1))
        start = 0
        while start < len(upto):
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
            n, f = many[start:end].ravel(), first[start:end].ravel()
            ends = np.cumsum(n)
            p = self.order[np.arange(ends[-1]) - np.repeat(ends - n - f, n)]
            g = np.repeat(np.repeat(np.arange(start, end), many.shape[1]), n)
            near = np.ones(len(p), bool)
            for near_by, x, y in zip(self.nears, xs, self.xs):
                reach = near_by.of(x)
                near &= np.abs(x[g] - y[p]) <= reach[g]
            g, p = g[near], p[near]
            sort = np.lexsort((p, g))
            p, cuts = p[sort].tolist(), np.searchsorted(g[sort], np.arange(start, end + 1)).tolist()
            yield start, [p[a:b] for a, b in zip(cuts, cuts[1:])]
            start = end


def settled(g_idx: np.ndarray, gx: list[np.ndarray], held: np.ndarray, p_idx: np.ndarray, px: list[np.ndarray], holder: np.ndarray, nears: list[Near]) -> dict[int, int | None]:
    """The G rows (numbers in row order) that ask anew, with the P row (number) that each gets, or None.

    held: the P row that a G row holds or has asked for last, -1: none yet; holder: the smallest G row that has asked for a P row so far. Who isn't the holder of its P row asks on.
    """
    side, out = Side(px, nears), {}
    least, owner = holder.tolist(), {p: n for n, p in enumerate(held.tolist()) if p >= 0 and holder[p] == g_idx[n]}
    waiting = np.flatnonzero((held < 0) | (holder[held] != g_idx)) if len(p_idx) else np.arange(0)
    while len(waiting):
        lost = []
        out.update(dict.fromkeys(waiting.tolist()))
        for start, lists in side.candidates([x[waiting] for x in gx]):
            for n, g, found in zip(waiting[start : start + len(lists)].tolist(), g_idx[waiting[start : start + len(lists)]].tolist(), lists):
                for p in found:
                    if least[p] > g:
                        if p in owner:
                            lost.append(owner[p])
                        least[p], owner[p], out[n] = g, n, p
                        break
        waiting = np.array(sorted(lost), np.int64)
    return out


def first_in_reach(g: DataFrame, p: DataFrame, nears: list[Near]) -> DataFrame | None:
    """g_idx, p_idx: in order of g_idx each G row takes the first free P row that is near in all numbers. None if more than CROWD rows stand within a few reaches of x0, which ranges don't divide.

    g and p: row_idx and, in the order of nears, x0, x1 and so on (doubles); a null is near nothing. x0 has a fixed reach.
    """
    spark, names = g.sparkSession, [f"x{i}" for i in range(len(nears))]
    ensure_importable(spark)
    of = lambda df, s: df.select(F.lit(s).cast("tinyint").alias("side"), F.col("row_idx").alias("idx"), *names).dropna()
    rows = materialize(of(g, 0).unionByName(of(p, 1)), "reach")
    if (bounds := borders(rows, nears[0].reach)) is None:
        return None
    edges = [-np.inf, *bounds, np.inf]
    between = list(zip(edges, edges[1:]))
    far = [min(AROUND * nears[0].reach, (b - a) / 2, (c - b) / 2) for a, b, c in zip(edges, edges[1:], edges[2:])]
    around = [(b - f, b + f) for b, f in zip(bounds, far)]
    fields = ", ".join(["cell int, side tinyint, idx long", *(f"{n} double" for n in names)])

    def dealt(df: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
        low, high = (np.array(x) for x in zip(*ranges))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, is_p = batch["x0"].to_numpy(), batch["side"].to_numpy() == 1
                wide = np.where(is_p, wider(x, nears[0].reach), 0.0)
                first, last = np.searchsorted(high, x - wide, "right"), np.searchsorted(low, x + wide, "right")
                n = np.maximum(last - first, 0)
                ends = np.cumsum(n)
                row = np.repeat(np.arange(len(x)), n)
                cell = np.arange(len(row)) - np.repeat(ends - n - first, n)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.take(pa.array(row)).columns], names=["cell", *batch.schema.names])

        return df.select("side", "idx", *names).mapInArrow(deal, fields)

    def settle(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        is_p = table["side"].to_numpy() == 1
        idx, state, xs = table["idx"].to_numpy(), table["state"].to_numpy(), [table[n].to_numpy() for n in names]
        g_idx, p_idx, gx, px = idx[~is_p], idx[is_p], [x[~is_p] for x in xs], [x[is_p] for x in xs]
        asked = state[~is_p]
        held = np.where(asked < 0, -1, np.searchsorted(p_idx, asked))
        found = settled(g_idx, gx, held, p_idx, px, np.where(state[is_p] < 0, NOBODY, state[is_p]), nears)
        ns = np.array(list(found), np.int64)
        return pa.table({"g_idx": pa.array(g_idx[ns], pa.int64()), "p_idx": pa.array([None if x is None else int(p_idx[x]) for x in found.values()], pa.int64()), "x0": pa.array(gx[0][ns], pa.float64())})

    def asked(df: DataFrame, cells: int) -> DataFrame:
        # twice as many tasks as ranges: a range takes longer than its bytes suggest, so tasks are not put together
        return df.repartition(2 * cells, "cell").groupBy("cell").applyInArrow(settle, "g_idx long, p_idx long, x0 double")

    none = F.lit(-1).cast("long").alias("state")
    links = materialize(asked(dealt(rows, between).withColumn("state", none), len(between)).where("p_idx IS NOT NULL"), "asked")
    turn = 0
    while True:
        holders = links.groupBy("p_idx").agg(F.min("g_idx").alias("holder"), F.count("*").alias("n"))
        lost = materialize(links.join(holders.where("n > 1"), "p_idx").where("g_idx > holder").select(F.lit(0).cast("tinyint").alias("side"), F.col("g_idx").alias("idx"), "x0", *(F.lit(0.0).alias(n) for n in names[1:])), "lost", lean=True)
        if lost.isEmpty():
            return links.select("g_idx", "p_idx")
        turn += 1
        ranges = around if turn % 2 else between
        ranges = [ranges[x.cell] for x in dealt(lost, ranges).select("cell").distinct().orderBy("cell").collect()]  # a row a range
        remove(lost)
        if not ranges:
            continue
        of_g, of_p = links.select("g_idx", F.col("p_idx").alias("state")), holders.select("p_idx", F.col("holder").alias("state"))
        some = materialize(dealt(rows, ranges), "near")
        some = some.where("side = 0").join(of_g.withColumnRenamed("g_idx", "idx"), "idx").unionByName(some.where("side = 1").join(of_p.withColumnRenamed("p_idx", "idx"), "idx", "left").withColumn("state", F.coalesce("state", none)))
        moved = materialize(asked(some.select("cell", "side", "idx", *names, "state"), len(ranges)), "moved", lean=True)
        after = materialize(links.join(moved, "g_idx", "left_anti").unionByName(moved.where("p_idx IS NOT NULL")), "asked", lean=True)
        remove(links)
        links = after


def borders(rows: DataFrame, reach: float) -> list[float] | None:
    """Values of x0 between which about RANGE rows lie, not too near each other; None if more than CROWD rows would lie between two of them."""
    n = rows.count() // RANGE
    found = (rows.agg(F.percentile_approx("x0", [i / (n + 1) for i in range(1, n + 1)], 100 * (n + 1)).alias("at")).first().at or []) if n else []
    kept, steps = [], 1
    for x in found:
        if np.isfinite(x) and (not kept or x - kept[-1] >= WIDTH * reach):
            kept.append(x)
            steps = 0
        steps += 1
        if steps * RANGE > CROWD:
            return None
    return kept
