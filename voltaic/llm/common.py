"""Shared helpers: document columns, worker state, Arrow row iteration, components."""

from __future__ import annotations

import builtins
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.session import materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` long and ``text`` string alone: further columns, whatever their
    names, never meet an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def doc_bytes(docs: DataFrame) -> DataFrame:
    """As ``doc_texts``, with ``text`` as its UTF-8 bytes."""
    return doc_texts(docs).withColumn("text", F.col("text").cast("binary"))


def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key (``k1``, ``k2``) that is never null: rows share it if ``doc_id`` and
    ``text`` are the same, null or not."""
    doc_id = F.col("doc_id").cast("long")
    return docs.withColumns({"k1": F.coalesce(doc_id, F.lit(0)), "k2": F.xxhash64("text", doc_id.isNull(), F.col("text").isNull())})


def worker_state(name: str, make: Callable, version=None):
    """An object a reused Python worker keeps from task to task (vocabularies, caches): one
    for each name, made anew when the version changes.  Names begin with their operator's
    and a colon; the state of other operators is dropped, so a worker that serves one
    stage after another never holds the sum of all caches."""
    store = builtins.__dict__.setdefault("_voltaic_worker_state", {})
    operator = name.partition(":")[0]
    for other in [n for n in store if n.partition(":")[0] != operator]:
        del store[other]
    if name not in store or store[name][0] != version:
        store[name] = (version, make())
    return store[name][1]


def row_slices(batches: Iterator[pa.RecordBatch], max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``max_rows`` rows, so Python copies stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            yield batch.slice(at, max_rows)


def connected_components(edges: DataFrame, prefix: str) -> DataFrame:
    """(``node``, ``root``) for every node of the long pairs (``u``, ``v``); the root is
    the least node of the component.

    Alternating large-star and small-star steps: joins and distinct only, each step
    written to the shared checkpoint folder, until the edge set stops changing.
    """
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), prefix)
    signature = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every pair now has a > b: the small star links a's lower neighbours and a to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
                 .union(low.select(F.col("a").alias("u"), F.col("m").alias("v")))
                 .where("u <> v").distinct())
        edges = materialize(small, prefix)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
