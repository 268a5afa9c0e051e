"""Exact dedup as a stream: keyed state on disk (RocksDB) keeps digest, stable identifier and content locator of every text, without expiry.

Documents are read as a stream of files. The stream is grouped by digest: each input task hands over one entry a digest, so a text that a third of all rows repeat is no hot key. The state of a digest is
the largest entry (doc_id, file, row of the file) and how many rows there were; without a watermark it is never dropped, and a later run over a folder with new files goes on where the last one stopped.

A digest that occurs twice is a hit and proves nothing yet: rows are compared by their whole texts, again with one row a text and task before the shuffle. Texts that share a digest and differ are told
apart there (clashes), so the result doesn't rest on the digest.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm._store import materialize, new_path

#: Micro-batches that a run over new files is cut into.
BATCHES = 3
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of the many small stores takes megabytes ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

Digest = Callable[[Column], Column]


def whole() -> Column:
    return F.coalesce("text", F.lit(""))


def sha256(text: Column) -> Column:
    """Lower-case hex over UTF-8."""
    return F.sha2(text, 256)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def entries(docs: DataFrame, digest: Digest, *more: Column) -> DataFrame:
    """digest and entry (doc_id, file, row) of every row, and more columns; a null text is empty."""
    at = docs.metadataColumn("_metadata")
    entry = F.struct(F.col("doc_id").alias("doc_id"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    return docs.select(digest(whole()).alias("digest"), entry.alias("entry"), *more)


def advance(spark: SparkSession, path: str, index: str, digest: Digest = sha256, batches: int = BATCHES) -> None:
    """Bring the state in the folder `index` up to all Parquet files under `path`; files that it has seen are not read again."""
    known = spark.read.parquet(path)
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern that only path matches: as a pattern, the stream also takes a single file
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(known.inputFiles()) / batches))).parquet(path)
    state = entries(stream, digest).groupBy("digest").agg(F.max("entry").alias("keep"), F.count("*").alias("n"))

    def keep(changed: DataFrame, nth: int) -> None:  # a batch that is run again writes the same rows to the same place
        changed.coalesce(4 * spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{index}/changes/batch={nth:06d}")

    with settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{index}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, index: str) -> DataFrame:
    """digest, keep (the largest entry), n: the state as the last batch left it."""
    changes = spark.read.schema("digest string, keep struct<doc_id: bigint, file: string, row: bigint>, n bigint, batch int").parquet(f"{index}/changes")
    return changes.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))  # both only grow


def clashes(docs: DataFrame, digest: Digest) -> DataFrame:
    """Digests that different texts share."""
    return docs.select(digest(whole()).alias("digest"), whole().alias("whole")).groupBy("digest", "whole").agg(F.count("*")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_dedup_files(spark: SparkSession, path: str, index: str | None = None, digest: Digest = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row of the Parquet files under `path`; columns doc_id and text are read, others don't matter.

    index: folder of the state, kept for later runs; a new one in the shared folder if None. Texts are equal if all bytes are; null is the empty text. Of equal texts the row with the largest doc_id stays,
    a null doc_id only among its like; of equal rows of that doc_id the one that stands last stays, so every group keeps exactly one row. An empty table gives no rows.
    """
    index = index or new_path(spark, "dedup-index")
    docs = spark.read.parquet(path)
    if not docs.inputFiles():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, digest string")
    advance(spark, path, index, digest)
    shared = materialize(clashes(docs, digest), "dedup-clashes", lean=True)
    rows, state = entries(docs, digest), current(spark, index)
    found = None
    if not shared.isEmpty():
        apart = entries(docs, digest, whole().alias("whole")).join(shared, "digest", "left_semi")
        best = apart.groupBy("digest", "whole").agg(F.max("entry").alias("keep"), F.count("*").alias("n"))
        found = apart.join(best, ["digest", "whole"]).drop("whole")
        rows = rows.join(shared, "digest", "left_anti")
    plain = rows.join(state, "digest")
    out = plain if found is None else plain.unionByName(found)
    return out.select("entry.doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("entry").eqNullSafe(F.col("keep")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """exact_dedup_files() of any table with doc_id and text: its two columns are written as files first, and the stream reads these."""
    path = new_path(docs.sparkSession, "dedup-documents")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.parquet(path)
    return exact_dedup_files(docs.sparkSession, path, digest=digest)
