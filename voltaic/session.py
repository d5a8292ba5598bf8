"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI semantics stay on (operators use try_cast /
# try_divide), dates are UTC, AQE re-plans joins and coalesces small shuffles and
# splits skewed join partitions at run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "voltaic",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Return the active session or build one (local only when no master is given)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER") and SparkSession.getActiveSession() is None:
        builder = builder.master("local[*]")
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  Only where it is unset and the master
    is local (tests) a fresh scratch folder takes its place; on a cluster that would be a
    folder other machines cannot see, so it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} shares")
    local = tempfile.mkdtemp(prefix="voltaic-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


#: Intermediate tables written by this process that release_intermediates() deletes.
_INTERMEDIATE: list[str] = []


def intermediate_path(spark: SparkSession, prefix: str) -> str:
    """A fresh scratch path that release_intermediates() deletes."""
    path = scratch_path(spark, f"{prefix}_{uuid.uuid4().hex[:16]}")
    _INTERMEDIATE.append(path)
    return path


#: Whether a query's shuffle files go when it ends, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: list[str] = []
_LOCK = threading.Lock()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it a write leaves no shuffle files: its rows are in what it wrote.  (A plan that is run
    again makes them anew.)  Threads may enter it side by side."""
    with _LOCK:
        _FREEING.append(spark.conf.get(FREED, "false"))
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _FREEING.pop()
            if not _FREEING:                              # the last to leave finds what the first found
                spark.conf.set(FREED, before)


def materialize(df, prefix: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it
    back: cuts the lineage, runs the upstream plan exactly once (unlike
    ``Dataset.checkpoint``, which computes it for the count and again for the
    write) and keeps a columnar copy that later passes prune and filter."""
    spark = df.sparkSession
    path = intermediate_path(spark, prefix)
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables that ``materialize`` wrote so far; call it when the
    results built on them are written or no longer needed.  Returns their number."""
    n = len(_INTERMEDIATE)
    while _INTERMEDIATE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_INTERMEDIATE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def min_partitions(spark) -> int:
    """Lower bound on the file count of a materialised table: enough splits to
    keep every core busy; larger tables keep their own (higher) partitioning."""
    sp = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2 * spark.sparkContext.defaultParallelism, sp)
