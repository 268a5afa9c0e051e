"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each whole text gives STATS numbers. They are standardised over the labelled training rows and mapped to
FEATURES cosines whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal
equations; only the summed (FEATURES+1)-sized system reaches the driver, where the ridge weights are solved. A
second part of the training rows calibrates: their labels are counted in GRID bins of the raw score, the pool-adjacent-violators
rule makes the rates monotone, and scores interpolate between the pooled blocks.

Folds by crc32 of the decimal doc_id mod 5: 0 is held out, 1 to 3 fit the weights, 4 calibrates. Labels, language, source and doc_id are
no inputs of a score.

Nulls and edge cases: a null text is empty and is scored; a null doc_id counts as held out; a document with several labels
takes the rounded mean; repeated rows are scored each; without labelled rows every score is 0.5; empty tables give an empty result; only doc_id and
text are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm._store import materialize
from ledgerloom.llm._text import WordHashes, base_counts, texts
from ledgerloom.sources.session import ensure_importable

STATS = ("words", "word_length", "symbols", "digits", "upper", "exclaims", "commas_stops", "distinct", "repeats", "dup_lines", "lines", "line_words", "top_word", "doubled", "non_ascii")
FEATURES = 192
SCALE = 2.5
RIDGE = 1.0
SEED = 7
GRID = 2000
LOW, HIGH = -0.5, 1.5
CUT = 0.3

DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))


def statistics(raw: bytes, hashes: np.ndarray) -> tuple[float, ...]:
    """STATS of one text; all 0 for a text without words."""
    n, chars, symbols, dup_lines, repeats = base_counts(raw, hashes)
    if not n:
        return (0.0,) * len(STATS)
    size = len(raw)
    share = lambda chosen: (size - len(raw.translate(None, chosen))) / size
    _, counts = np.unique(hashes, return_counts=True)
    lines = raw.count(b"\n") + 1
    return (
        float(np.log1p(n)), chars / n, symbols / size, share(DIGITS), share(UPPER), share(b"!"), share(b",."), len(counts) / n, repeats / n, dup_lines / lines,
        float(np.log1p(lines)), float(np.log1p(n / lines)), float(counts.max()) / n, float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0, (size - chars) / size,
    )


@dataclass
class Model:
    """Everything a score needs; its size depends on FEATURES and GRID only."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier(np.clip((x - self.mean) / self.std, -6, 6))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # a thousandth of the raw score keeps order within a calibrated block
        return np.clip(0.999 * np.interp(raw, self.xs, self.ys) + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random cosines with a constant; the directions follow from SEED."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / SCALE, (z.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack((np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))))


def stats_table(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every text."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            rows = np.array([statistics(t, table.of(t.split())) for t in texts(batch.column(1))]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATS))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """0 to 4; null gives 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5, F.lit(0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS])


def isotonic(value: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and rates of the blocks, in order of value."""
    blocks: list[list[float]] = []
    for v, g, n in zip(value, good, count):
        blocks.append([v * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labelled rows outside the held-out fold; None without such rows."""
    spark = stats.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("y"))
    train = stats.join(known, "doc_id").withColumn("fold", fold()).where("fold != 0").drop("doc_id")
    train = materialize(train, "classifier-train", lean=True)
    part = train.where("fold != 4")
    seen = part.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in STATS), *(F.stddev_pop(c).alias(f"s_{c}") for c in STATS)).first()
    if not seen.n:
        return None
    mean = np.array([seen[f"m_{c}"] for c in STATS])
    std = np.array([seen[f"s_{c}"] for c in STATS])
    model = Model(mean, np.where(std < 1e-9, 1.0, std), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(matrix(batch))
            total += z.T @ np.column_stack((z, batch.column("y").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(r) for r in table.column("row").to_pylist()], axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in part.mapInArrow(equations, "i int, row array<double>").groupBy("i").applyInArrow(summed, "i int, row array<double>").collect():
        system[r.i] = r.row
    model.weights = np.linalg.solve(system[:, :-1] + RIDGE * np.eye(FEATURES + 1), system[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, count = np.zeros(GRID), np.zeros(GRID)
        for batch in batches:
            at = np.clip((model.raw(matrix(batch)) - LOW) / (HIGH - LOW) * GRID, 0, GRID - 1).astype(int)
            np.add.at(good, at, batch.column("y").to_numpy())
            np.add.at(count, at, 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(good[at]), pa.array(count[at])], ["bin", "good", "n"])

    bins = train.where("fold = 4").mapInArrow(binned, "bin int, good double, n double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()  # at most GRID rows
    if bins:
        bins.sort(key=lambda r: r.bin)
        centre = LOW + (np.array([r.bin for r in bins]) + 0.5) * (HIGH - LOW) / GRID
        model.xs, model.ys = isotonic(centre, np.array([r.good for r in bins]), np.array([r.n for r in bins]))
    else:
        model.xs, model.ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def predict(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            s = np.full(len(x), 0.5) if model is None else model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled part of docs and score all of them."""
    stats = materialize(stats_table(docs), "classifier-stats")
    return predict(stats, fit(stats, labels))
