"""Session settings and shared-folder handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime SQL settings that can be changed on a session somebody else started.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also split a hot key when the consumer would reuse the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Tables in few folders are written without sorting their rows by folder.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

# Settings while a table is staged.
STAGING_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "12m",
    # Tasks that read files combine and sort what they make of them: few rows a task, however large the files are.
    "spark.sql.files.maxPartitionBytes": "16m",
}

# How many parts shuffles are cut into while a table is staged: one for so many bytes of the input files, and at most so many.
PARTS, PART_BYTES, MOST_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 1 << 20, 2000

# Settings that only a new session can take.
START_CONF = {
    # No call-site capture per expression: plans here are large and built from many small ones.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "treecorpus") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TREECORPUS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **START_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, a session inside one machine (``local[...]``) gets a temporary folder; on a
    cluster that is an error, for executors and driver would each see a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="treecorpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_STAGED: dict[tuple, str] = {}


def listing(spark: SparkSession, folder: str) -> tuple[int, int, int]:
    """How many files a folder holds, a sum over their names, sizes and times, and their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    mark = F.xxhash64("path", "length", "modificationTime") % F.lit(2**31)
    return tuple(files.agg(F.count("*"), F.coalesce(F.sum(mark), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first())


def staged(spark: SparkSession, name: str, folder: str, build: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """A table derived from the files of ``folder``, written once per application to the shared folder and read from there.

    Lost executors then re-read files instead of recomputing the derivation. New files in the folder
    give a new table. ``by`` are integer columns whose values are kept in folders of their own, so that a
    reader of one value reads no other.
    """
    return spark.read.parquet(staged_path(
        spark, name, folder, lambda path: build().write.partitionBy(*by).option("compression", "zstd").parquet(path)))


def staged_path(spark: SparkSession, name: str, folder: str, write: Callable[[str], object]) -> str:
    """As :func:`staged` for files of any kind: ``write`` makes them under the path it is given."""
    at = _place(spark, name, folder)
    if at not in _STAGED:
        path = scratch_path(spark, name)
        # Bodies are made from narrow rows and sorted: a task takes few of these, so that its bodies fit in memory.
        # Parts grow with the input, so that a task's rows don't; adaptive execution puts small ones together.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(at[-1] // PART_BYTES, MOST_PARTS))
        own = {**STAGING_CONF, PARTS: str(parts)}
        before = {key: spark.conf.get(key, None) for key in own}
        try:
            for key, value in own.items():
                spark.conf.set(key, value)
            write(path)
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        _STAGED[at] = path
    return _STAGED[at]


def already_staged(spark: SparkSession, name: str, folder: str) -> str | None:
    """The path that :func:`staged_path` has written for this table before, if it has."""
    return _STAGED.get(_place(spark, name, folder))


def _place(spark: SparkSession, name: str, folder: str) -> tuple:
    return (spark.sparkContext.applicationId, name, folder, *listing(spark, folder))
