"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every word 1-gram and 2-gram of every text is hashed into BUCKETS counters. Two multinomials are counted in
one pass: over all documents (raw) and over the trusted ones (target). A document's score is the mean over its
n-grams of log((target + SMOOTH) / (expected + SMOOTH)), where expected is the raw count scaled to the target's
size: 0 for text that is as common among trusted documents as anywhere. It is kept if no base rule fails and
its score reaches THRESHOLD.

Nulls and edge cases: a null text is empty; a text without words has score 0 and fails the base rule; a null
doc_id is never trusted but is scored; repeated rows are scored each; a document with several labels is trusted if all of
them say 1; empty tables give an empty result; other columns are carried along, and the struct column replaces
a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm._text import WordHashes, base_counts, mixed, texts
from ledgerloom.sources.session import ensure_importable

#: Fixed size of the hashed n-gram space: it bounds the model whatever the corpus.
BUCKETS = 1 << 16
SMOOTH = 5.0
THRESHOLD = -0.13
MIN_WORDS = 50
REPEAT_PERCENT = 50

FIELDS = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("llr", T.DoubleType(), False), T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)]
)


def grams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the 1-grams and 2-grams."""
    one = mixed(hashes)
    two = mixed(hashes[:-1] * np.uint64(3) ^ hashes[1:])
    return (np.concatenate((one, two)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that every label marks as good."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def count_ngrams(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts over all documents and over the trusted ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, raw, target = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                g = grams(table.of(text.split()))
                n = np.bincount(g, minlength=BUCKETS) if len(g) > BUCKETS // 8 else None
                for into in (raw, target) if good else (raw,):
                    if n is None:
                        np.add.at(into, g, 1)
                    else:
                        into += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    good = trusted.select("doc_id").distinct().withColumn("good", F.lit(True)).hint("shuffle_hash")
    both = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", "good")
    return both.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of every bucket: BUCKETS doubles, whatever the corpus."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in count_ngrams(docs, trusted).collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + SMOOTH) / (expected + SMOOTH))


def score(docs: DataFrame, llr: np.ndarray, out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column of FIELDS."""
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.drop(out)
    model, where = spark.sparkContext.broadcast(llr), docs.columns.index("text")
    arrow = pa.struct([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = WordHashes(), model.value
        for batch in batches:
            rows = []
            for text in texts(batch.column(where)):
                h = table.of(text.split())
                counts = base_counts(text, h)
                value = float(weights[grams(h)].mean()) if len(h) else 0.0
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
                rows.append((*counts, value, failed, not failed and value >= threshold))
            cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(cols, [f.name for f in arrow])], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, FIELDS)]))


def quality_rules(docs: DataFrame, labels: DataFrame, out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the struct column `out`: counts, score (llr), base_failed and the verdict (kept)."""
    ensure_importable(docs.sparkSession)
    return score(docs, fit(docs, trusted_ids(labels)), out, threshold)
