"""Tables in the folder that the driver and all executors share: cuts of the lineage that outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Files for each core of a lean table.
LEAN_FILES = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset (tests, one machine) a temporary one is set; a cluster must name one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """Tables between steps go when the application ends in good order."""
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove(path, spark)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back: a cut of the lineage that outlives executors.

    lean: df is the small outcome of a shuffle (keys, links, counts); it is written in a few files for each core, not one for each shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.coalesce(LEAN_FILES * spark.sparkContext.defaultParallelism) if lean else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    spark = spark or df_or_path.sparkSession
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
