"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Largest inner product becomes least distance by one more coordinate: a row x gets sqrt(M^2 - |x|^2), M the largest norm, an anchor gets 0; then |a - x|^2 = |a|^2 + M^2 - 2 a.x. Rows fall to the nearest of
a few pivots (rows themselves). The anchors of a cell form groups of bounded size. A group needs only rows whose distance from its pivot lies between two bounds, by the triangle inequality:

    inner = least over anchors of (nearest distance that can count - distance to the pivot),   outer = most over anchors of (distance to the pivot + farthest distance that can count)

How far can count, is known from a bounded sample of rows: the n-th best of the sample is never better than the n-th best of all. The bounds drop pairs that can't matter and nothing else; with loose
bounds more rows travel, and results are the same. A row that a group needs is sent there; a cell with many rows is dealt in chunks, and so are its group's anchors, so no task meets a whole cell. Inside a
(group, chunk) an exact join of blocks of integers gives the best few of each anchor, and a window merges chunks.

Two rounds: positives first (same label), then negatives, whose windows depend on the positives' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm._store import materialize
from ledgerloom.sources.session import ensure_importable

#: Fixed values of the contract.
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH, UNIT = 50, 95, 100
#: Rows for each pivot, and how many pivots there are at least and at most.
CELL, PIVOTS = 4096, (8, 512)
#: Rows whose scores give the first bounds: a sample by hash, of this size whatever the table's.
SAMPLE = 2048
#: Anchors of a group, and rows of a chunk of a cell.
GROUP, CHUNK = 1024, 16384
#: Rows that a worker scores at once, and rows that it sends at once.
BLOCK, SENT = 1024, 32768
#: Relative slack of float bounds over exact integers.
SLACK = 1e-6


def quantised(rows: DataFrame, anchor: Column) -> DataFrame:
    """vec_id, label, vec (floor(SCALE * x) of each component) and is_anchor of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.select("vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    vec = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.cast("array<long>").alias("vec"), "is_anchor")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


@dataclass(frozen=True)
class Space:
    """What every task knows: the width of vectors, M^2, whether floats hold all scores exactly, pivots with their last coordinate, the sample's ids, labels and vectors. All of it has bounded size."""

    width: int
    square: float
    floats: bool
    pivots: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of integer rows, as integers."""
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if self.floats else a @ b.T

    def raised(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Rows with the coordinate that makes norms equal; 0 for anchors."""
        x = x.astype(np.float64)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0.0, self.square - (x * x).sum(1)))
        return np.column_stack([x, last])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of raised rows to all pivots."""
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square))

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance between an anchor of squared norm and a row that a score stands for."""
        return np.sqrt(np.maximum(0.0, norms + self.square - 2 * scores))


def space_of(rows: DataFrame) -> Space | None:
    """Pivots and sample by hash order of ids; None without rows."""
    size = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, square = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(size)).first()
    if not n:
        return None
    if square >= 2.0**62:
        raise ValueError("scores of these vectors don't fit a long")
    few = rows.select("vec_id", "label", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()  # at most SAMPLE rows
    vec = matrix(pa.array([r.vec for r in few], pa.list_(pa.int64())), width)
    plain = Space(width, float(square), square < 2.0**52, np.zeros((1, width + 1)), np.array([r.vec_id for r in few]), np.array([r.label for r in few]), vec)
    count = min(max(PIVOTS[0], n // CELL), PIVOTS[1])
    pivots = np.unique(plain.raised(vec[:count]), axis=0)  # equal rows make one cell
    return Space(plain.width, plain.square, plain.floats, pivots, plain.ids, plain.labels, plain.sample)


ROW = "vec_id long, label long, vec array<long>"
KEY = ["to", "part", "cell", "chunk"]


def placed(rows: DataFrame, space: Space, anchors: bool = False) -> DataFrame:
    """vec_id, label, vec, cell (of the nearest pivot) and home (the distance to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = space.to_pivots(space.raised(matrix(b.column("vec"), space.width), anchors))
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "home"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"{ROW}, cell int, home double")


def nth_best(scores: np.ndarray, allowed: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest allowed score of each row, -inf if there are fewer."""
    s = np.where(allowed, scores.astype(np.float64), -np.inf)
    return np.full(len(s), -np.inf) if s.shape[1] < n else np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]


def positive_range(s: Space, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
    """Between which distances a positive of each anchor lies."""
    able = (labels[:, None] == s.labels) & (ids[:, None] != s.ids)
    least = nth_best(s.scores(a, s.sample), able, POSITIVES)
    return np.zeros(len(a)), s.reach((a.astype(np.float64) ** 2).sum(1), least)


def negative_range(s: Space, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, goals: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Between which distances a negative of any positive of each anchor lies. goals: the positives' scores."""
    scores, norms = s.scores(a, s.sample), (a.astype(np.float64) ** 2).sum(1)
    near, far = np.full(len(a), np.inf), np.zeros(len(a))
    for i, mine in enumerate(goals):
        for p in mine:
            inside = (labels[i] != s.labels) & (LOW * p <= UNIT * scores[i]) & (UNIT * scores[i] <= HIGH * p)
            least = max(LOW * p / UNIT, nth_best(scores[i : i + 1], inside[None], NEGATIVES)[0])
            near[i], far[i] = min(near[i], s.reach(norms[i], np.float64(HIGH * p / UNIT))), max(far[i], s.reach(norms[i], np.float64(least)))
    return near, far


def ranged(anchors: DataFrame, space: Space, bounds: Callable) -> DataFrame:
    """anchors (placed, with goals) with near and far, which the sample gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels = (b.column(c).to_numpy() for c in ("vec_id", "label"))
            near, far = bounds(space, ids, labels, matrix(b.column("vec"), space.width), b.column("goals").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(far)], names=[*b.schema.names, "near", "far"])

    return anchors.mapInArrow(run, f"{ROW}, cell int, home double, goals array<long>, near double, far double")


@dataclass(frozen=True)
class Plan:
    """A number or two for each pivot: bounds and parts of its anchors, chunks of its rows, and which cells' rows its anchors may need."""

    inner: np.ndarray
    outer: np.ndarray
    parts: np.ndarray
    chunks: np.ndarray
    alive: np.ndarray


def plan_of(rows: DataFrame, anchors: DataFrame, space: Space) -> Plan:
    """From one row a pivot of either side."""
    n = len(space.pivots)
    inner, outer, parts, chunks, radius = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
    slack = SLACK * (1.0 + 2.0 * space.square**0.5)
    for r in anchors.groupBy("cell").agg(F.min(F.col("near") - F.col("home")).alias("inner"), F.max(F.col("far") + F.col("home")).alias("outer"), F.count("*").alias("n")).collect():
        inner[r.cell], outer[r.cell], parts[r.cell] = r.inner - slack, r.outer + slack, -(-r.n // GROUP)
    for r in rows.groupBy("cell").agg(F.max("home").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], chunks[r.cell] = r.radius, -(-r.n // CHUNK)
    apart = space.to_pivots(space.pivots)
    alive = (parts[:, None] > 0) & (apart + radius + slack >= inner[:, None]) & (apart - radius - slack <= outer[:, None])
    return Plan(inner, outer, parts, chunks, alive)


def sent_rows(rows: DataFrame, space: Space, plan: Plan) -> DataFrame:
    """Rows replicated to every part of the anchors of the cells (to) whose bounds they lie between, with their own cell and chunk."""
    step = max(1, SENT // len(space.pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                far = space.to_pivots(space.raised(matrix(b.column("vec"), space.width)))
                row, to = np.nonzero((far >= plan.inner) & (far <= plan.outer) & (plan.parts > 0))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(to.astype(np.int32)), pa.array(plan.parts[to].astype(np.int32))], names=[*b.schema.names, "to", "parts"])

    chunks = F.element_at(F.array(*(F.lit(max(1, int(c))) for c in plan.chunks)), F.col("cell") + 1)
    dealt = rows.select("vec_id", "label", "vec", "cell", F.pmod(F.xxhash64("vec_id"), chunks).cast("int").alias("chunk"))
    sent = dealt.mapInArrow(run, f"{ROW}, cell int, chunk int, to int, parts int")
    return sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def sent_anchors(anchors: DataFrame, plan: Plan) -> DataFrame:
    """Anchors with their part, replicated to every chunk of the cells that may serve theirs (to)."""
    fans = [np.array([(f, c) for f in np.flatnonzero(ok) for c in range(plan.chunks[f])], np.int32).reshape(-1, 2) for ok in plan.alive]
    lengths = np.array([len(f) for f in fans])
    step = max(1, SENT // max(1, lengths.max()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                to = b.column("to").to_numpy()
                fan = np.concatenate([fans[t] for t in to])
                row = np.repeat(np.arange(len(to)), lengths[to])
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(fan[:, 0]), pa.array(fan[:, 1])], names=[*b.schema.names, "cell", "chunk"])

    parts = F.element_at(F.array(*(F.lit(max(1, int(p))) for p in plan.parts)), F.col("cell") + 1)
    mine = anchors.select("vec_id", "label", "vec", "goals", F.col("cell").alias("to"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))
    return mine.mapInArrow(run, f"{ROW}, goals array<long>, to int, part int, cell int, chunk int")


def best(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the n largest allowed scores of each row, earlier columns first among equals."""
    s = np.where(allowed, scores, np.iinfo(np.int64).min)
    k = min(n, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k else np.zeros(len(s))
    above, ties = allowed & (s > least[:, None]), allowed & (s == least[:, None])
    room = n - above.sum(1)
    taken = above | (ties & (np.cumsum(ties, axis=1) <= room[:, None]))
    return np.nonzero(taken)


def joined(anchors: DataFrame, rows: DataFrame, space: Space, negatives: bool) -> DataFrame:
    """anchor_id, goal, vec_id, score: of each anchor (and goal, the score of a positive) the best rows of each chunk, by an exact join in blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            ids, labels, a = left["vec_id"].to_numpy(), left["label"].to_numpy(), matrix(left["vec"], space.width)
            goals = left["goals"].to_pylist()
            of = np.repeat(np.arange(len(ids)), [len(g) for g in goals]) if negatives else np.arange(len(ids))
            goal = np.array([p for g in goals for p in g], np.int64) if negatives else np.zeros(len(ids), np.int64)
            n = NEGATIVES if negatives else POSITIVES
            for at in range(0, right.num_rows, BLOCK):
                part = right.slice(at, BLOCK)
                their, theirs = part["vec_id"].to_numpy(), part["label"].to_numpy()
                s = space.scores(a, matrix(part["vec"], space.width))
                same = labels[:, None] == theirs
                if negatives:
                    s, allowed = s[of], ~same[of]
                    allowed &= (UNIT * s >= LOW * goal[:, None]) & (UNIT * s <= HIGH * goal[:, None])
                else:
                    allowed = same & (ids[:, None] != their)
                i, j = best(s, allowed, n)
                out.append((of[i], goal[i], their[j], s[i, j]))
            i, p, v, s = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((v, -s, p, i))
            i, p, v, s = i[order], p[order], v[order], s[order]
            start = np.r_[True, (i[1:] != i[:-1]) | (p[1:] != p[:-1])] if len(i) else np.zeros(0, bool)
            nth = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else i
            keep = nth < n
            columns = [ids[i[keep]], p[keep], v[keep], s[keep]]
        else:
            columns = [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "goal", "vec_id", "score"])

    return anchors.groupBy(*KEY).cogroup(rows.groupBy(*KEY)).applyInArrow(run, "anchor_id long, goal long, vec_id long, score long")


def search(rows: DataFrame, anchors: DataFrame, space: Space, negatives: bool) -> DataFrame:
    """anchor_id, goal, rank, vec_id, score of the best of all rows."""
    anchors = materialize(ranged(anchors, space, negative_range if negatives else positive_range), "negatives-anchors", lean=True)
    plan = plan_of(rows, anchors, space)
    found = joined(sent_anchors(anchors, plan), sent_rows(rows, space, plan), space, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= (NEGATIVES if negatives else POSITIVES))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (rows where `anchor` is true).

    rows: vec_id, label, embedding; other columns don't matter. Scores are inner products of floor(SCALE * x). Positives of an anchor are its first POSITIVES rows of the same label, negatives of a positive the first
    NEGATIVES rows of other labels with LOW to HIGH percent of the positive's score; larger scores come first, ties by smaller vec_id. Rows with a null id, label, vector or component, or with a component that
    is not finite, take no part; shorter vectors count as filled with zeros. Rows with the anchor's vec_id are no partners of it; of several rows with an anchor's vec_id the smallest
    (label, vector) is the anchor; other repeated rows count as often as they are there. Without rows or anchors there is no result. Scores beyond a long raise an error.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    taking = materialize(quantised(rows, anchor), "negatives-rows")
    space = space_of(taking)
    if space is None:
        return spark.createDataFrame([], RESULT)
    cells = materialize(placed(taking, space), "negatives-cells")
    chosen = taking.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec")
    anchors = materialize(placed(chosen, space, anchors=True).withColumn("goals", F.array().cast("array<long>")), "negatives-asked", lean=True)
    positives = materialize(search(cells, anchors, space, negatives=False).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")), "negatives-positives", lean=True)
    goals = positives.where("goal >= 0").groupBy("anchor_id").agg(F.collect_set("goal").alias("goals"))  # POSITIVES at most; below 0 the window is empty
    asked = anchors.drop("goals").join(goals, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    negatives = search(cells, asked, space, negatives=True)
    return positives.join(negatives, ["anchor_id", "goal"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"))
