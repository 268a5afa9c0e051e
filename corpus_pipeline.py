"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the columns of documents.
run() writes each stage as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import byte_bpe, line_dedup, mixing, near_dedup, quality_rules
from ledgerloom.llm._store import materialize
from ledgerloom.sources.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_rules(docs.select(*COLUMNS), read(spark, sf_dir, "labels")).where("quality.kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and so do those of single long lines; every document stays, if without text."""
    kept = line_dedup.line_dedup(docs.select(*COLUMNS))
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest doc_id, null after all others; of several texts or equal rows of that doc_id one. Rows without words are in no group and stay."""
    keyed = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("doc_id", "text"))
    found = materialize(near_dedup.near_dedup(docs.select(*COLUMNS)).where("group is not null").select("doc_id", "_k", "group"), "pipeline-groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k")).alias("best"))
    mine = (F.col("best._k") == F.col("_k")) & F.col("best.doc_id").eqNullSafe(F.col("doc_id"))
    marked = materialize(found.join(best, "group").groupBy(F.col("doc_id").alias("_id"), "_k").agg(F.count("*").alias("_n"), F.bool_or(mine).alias("_best")), "pipeline-marked")
    same = (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = keyed.join(marked.where("not _best or _n > 1"), same, "left_anti").select(*COLUMNS)
    repeated = marked.where("_best and _n > 1")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_h"]).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of the bytes decoded from them."""
    encoded = byte_bpe.byte_bpe(docs.select("doc_id", "source", "text"), byte_bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return encoded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("quality_rules", filter_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the hashed n-gram verdict, the knapsack fit and BPE; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
