"""Incremental listing ingest (ST1) with Structured Streaming.

Newly landed listing files -> cleaning/extraction operators -> rows not seen before ->
append.  Which rows were seen is the stream's own state (``dropDuplicatesWithinWatermark``
on the whole-row hash, in RocksDB on the shared checkpoint location), so no micro-batch
reads the target.  State is kept for ``horizon`` of processing time; the default keeps all
of it, so the target is full-row distinct and equals the batch append-distinct (S9) of the
same files.  With ``availableNow`` the stream processes everything landed so far and
stops; the checkpoint records which files were consumed and the state that went with them.

A batch's files carry the stream's id and the batch's number, and a replayed batch first
takes away what it left before, so a restart after the loss of an executor or the driver
neither skips nor repeats a row.  A stream that starts anew (its checkpoint was lost)
over a target with rows keeps those rows' hashes beside its checkpoint and drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import intermediate_path
from ..sources.files import has_files, move_in

#: Processing time within which duplicates are recognised: longer than any table lives.
HORIZON = "36500 days"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HASHES = ["__h1", "__h2"]


def with_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` with two 64-bit hashes of the whole row."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    return rows.withColumns({"__h1": F.xxhash64(*cols), "__h2": F.xxhash64(F.lit(1), *cols)})


def unseen_rows(stream: DataFrame, horizon: str = HORIZON, seed: DataFrame | None = None) -> DataFrame:
    """The rows of a stream that it did not bring before and whose hashes ``seed`` does not hold."""
    marked = with_hashes(stream).withColumn("__landed", F.current_timestamp())
    fresh = marked.withWatermark("__landed", horizon).dropDuplicatesWithinWatermark(HASHES)
    if seed is not None:
        fresh = fresh.join(seed, HASHES, "left_anti")
    return fresh.drop(*HASHES, "__landed")


def _land(target: str):
    """Appends a batch once: its files are written aside and moved in under the batch's own name."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = intermediate_path(spark, "ingest_batch")
        batch.write.parquet(staged)
        batch._jdf.queryExecution().logical().rdd().cleanShuffleDependencies(False)       # its rows are written, its state is kept
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        move_in(spark, staged, target.rstrip("/"), f"batch-{stream}-{batch_id:08d}-")
    return run


def ingest_available_now(spark: SparkSession, landing: str, schema: T.StructType, target: str,
                         checkpoint: str, transform=None, fmt: str = "parquet",
                         max_files_per_trigger: int | None = None, horizon: str = HORIZON) -> None:
    """Run the ingest stream until every landed file is processed."""
    seed = f"{checkpoint.rstrip('/')}_seed"
    if not has_files(spark, checkpoint) and has_files(spark, target):
        with_hashes(spark.read.parquet(target)).select(*HASHES).distinct().write.mode("overwrite").parquet(seed)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landing)
    if transform is not None:
        stream = transform(stream)
    fresh = unseen_rows(stream, horizon, spark.read.parquet(seed) if has_files(spark, seed) else None)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = fresh.writeStream.foreachBatch(_land(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
