"""Versioned tables: appended versions with a manifest, look-up of the latest row of a key, merges that keep links one to one, and fingerprints that tell a stale export.

A version is written under rows/version=N and counts once its line stands in the manifest; what a broken writer has left behind has no line, is never read and is written over. A version carries a token: appending with
a token that is known changes nothing, so a replay is safe. One writer at a time; readers need no lock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.sources.store import materialize

MANIFEST = "version long, token string, n long, state string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """version, token, n, state (an order-free fingerprint of the latest rows) of every version."""
    return spark.read.schema(MANIFEST).parquet(f"{at}/manifest") if exists(spark, f"{at}/manifest") else spark.createDataFrame([], MANIFEST)


def last_version(spark: SparkSession, at: str) -> int:
    return manifest(spark, at).agg(F.max("version")).first()[0] or 0


def rows_of(spark: SparkSession, at: str, schema: str, upto: int | None = None) -> DataFrame:
    """All rows of all versions (up to one) with their version."""
    upto = last_version(spark, at) if upto is None else upto
    if not upto:
        return spark.createDataFrame([], f"{schema}, version long")
    return spark.read.schema(f"{schema}, version long").parquet(f"{at}/rows").where(F.col("version") <= upto)


def latest(spark: SparkSession, at: str, schema: str, key: str, upto: int | None = None) -> DataFrame:
    """The row of the highest version of each key, with that version."""
    rows = rows_of(spark, at, schema, upto)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "version").alias("row"))
    return newest.select(key, "row.*").select(*rows.columns)


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Count and order-free hash."""
    h = F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    n, state = rows.select(h.alias("h")).agg(F.count("*"), F.sum("h")).first()
    return n, str(state or 0)


def append(spark: SparkSession, at: str, rows: DataFrame, schema: str, key: str, token: str) -> int:
    """Add rows (one a key) as the next version and return its number; with a known token nothing happens, and the number is that of then."""
    known = manifest(spark, at).where(F.col("token") == token).first()
    if known:
        return known.version
    version = last_version(spark, at) + 1
    rows.write.mode("overwrite").parquet(f"{at}/rows/version={version}")
    merged = spark.read.schema(f"{schema}, version long").parquet(f"{at}/rows").where(F.col("version") <= version)
    newest = merged.groupBy(key).agg(F.max_by(F.struct(*(c for c in merged.columns if c not in (key, "version"))), "version").alias("row")).select(key, "row.*")
    n, state = fingerprint(newest)
    spark.createDataFrame([(version, token, n, state)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{at}/manifest")
    return version


LINKS = "g_idx long, p_idx long"


def merge_links(spark: SparkSession, at: str, asked: DataFrame, token: str) -> DataFrame:
    """Merge links (g_idx, p_idx; a null p_idx releases) as a version and return those that are refused: g_idx, p_idx, reason.

    Refused are links to a P row that another G row holds in the version before (P_HELD; a row that is released by the same merge is free for the next one), all but the smallest G row of several that ask for one P row (P_ASKED_TWICE),
    and all but the first of several links of one G row (G_ASKED_TWICE; nulls last). So the latest links are one to one in every version.
    """
    held = latest(spark, at, LINKS, "g_idx").where("p_idx IS NOT NULL").select("p_idx", F.col("g_idx").alias("holder"))
    nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = asked.select("g_idx", "p_idx").distinct().withColumn("own", nth(["g_idx"], [F.asc_nulls_last("p_idx")])).join(held, "p_idx", "left")
    reason = F.when(F.col("own") > 1, "G_ASKED_TWICE").when(F.col("holder").isNotNull() & (F.col("holder") != F.col("g_idx")), "P_HELD")
    rows = rows.withColumn("reason", reason)
    first = rows.where("reason IS NULL AND p_idx IS NOT NULL").groupBy("p_idx").agg(F.min("g_idx").alias("first"))
    rows = rows.join(first, "p_idx", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("first") != F.col("g_idx"), "P_ASKED_TWICE")))
    judged = materialize(rows.select("g_idx", "p_idx", "reason"), "judged", lean=True)
    append(spark, at, judged.where("reason IS NULL").select("g_idx", "p_idx"), LINKS, "g_idx", token)
    return judged.where("reason IS NOT NULL")


def stale(exports: DataFrame, spark: SparkSession, at: str) -> DataFrame:
    """exports (export_id, version) with stale: whether the latest rows differ from those of the export's version."""
    states = manifest(spark, at)
    now = states.agg(F.max_by("state", "version").alias("now"))
    return exports.join(states.select("version", "state"), "version", "left").join(now).select("export_id", "version", (~F.col("state").eqNullSafe(F.col("now"))).alias("stale"))
