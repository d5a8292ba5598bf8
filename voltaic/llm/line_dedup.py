"""Line deduplication over levelled sorted runs of line hashes.

The store keeps, for every line key seen, its documents' number and largest ``doc_id``,
in runs sorted by key.  A batch of documents is aggregated to one row per key, is
anti-joined (sort-merge) with the runs to tell new lines from known ones, and adds its
own run at level 0.  When a level holds ``fanout`` runs they are merged into one run of
the next level, so a store of N batches holds O(log N) runs and rewrites each row
O(log N) times.  Keys are 128-bit hashes of the stripped, lower-cased line.  Each row keeps
the places of its keys' lines, so lines are hashed once and a text loses its dropped
places in one pass over them, however many they are.

Results for odd input: null and empty texts are one empty line; a null ``doc_id`` counts
as one document, smaller than all others; rows with the same ``doc_id`` are one document,
equal rows get equal results; an empty table gives no rows; further columns stay out of
the way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.session import intermediate_path

from .common import doc_texts

#: Fixed value: ASCII white space, stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"
#: A-Z and a-z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

KEYS = "k1 long, k2 long, doc_id long, t1 long, t2 long, places array<int>, batch int"

#: The struct of counts that deduplicate_lines() adds.
COUNTS = "_lines"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, min_chars: int) -> Column:
    """Struct of two 64-bit hashes of the key; null for keys under ``min_chars`` code points."""
    key = F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2")))


def text_key(text: Column) -> dict[str, Column]:
    """Two hashes of a row's text, null or not: with ``doc_id`` they tell rows apart that are not equal."""
    return {"t1": F.xxhash64(text, text.isNull()), "t2": F.xxhash64(F.lit(7), text)}


def batch_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(``k1``, ``k2``, ``doc_id``, ``t1``, ``t2``, ``places``): distinct long lines of each row and
    where they are (from 0).  Equal rows are one."""
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(line_key(x, min_chars).alias("k"), i.alias("place")))
    found = docs.select("doc_id", "t1", "t2", F.explode(F.filter(keys, lambda x: x["k"].isNotNull())).alias("line"))
    return (found.groupBy(F.col("line.k.k1").alias("k1"), F.col("line.k.k2").alias("k2"), "doc_id", "t1", "t2")
            .agg(F.collect_set("line.place").alias("places")))


class LineRuns:
    """Levelled runs of (``k1``, ``k2``, ``n_docs``, ``last_doc``) under one folder."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        run = f"{self.path}/level={level}/{uuid.uuid4().hex}"
        rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2").write.parquet(run)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*runs)
        return rows if len(runs) == 1 else rows.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def state(self) -> DataFrame | None:
        """One row per key over all runs, or None before the first batch."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None

    def _held(self, keys: DataFrame, how: str) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        held = self.spark.read.parquet(*runs).select("k1", "k2").hint("merge")
        return keys.join(held, ["k1", "k2"], how)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose line no run holds: a merge anti-join with the runs."""
        return self._held(keys, "left_anti") if self.levels else keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (``k1``, ``k2``, ``doc_id``), one row per document and key, whose
        documents come before all those of earlier batches.  Lines new to the runs get
        their last document here; known ones only add to the count.  Full levels are
        compacted."""
        batch = keys.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        rows = self.unseen(batch)
        if self.levels:
            rows = rows.unionByName(self._held(batch, "left_semi").withColumn("last_doc", F.lit(None).cast("long")))
        self._write(rows, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1


def repeated_lines(docs: DataFrame, keys_path: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(``k1``, ``k2``, ``last_doc``) of lines found in at least ``min_docs`` documents,
    gathered by batches of documents, last ids first, through the levelled runs.
    ``keys_path`` receives the distinct keys of each row of ``docs`` (``doc_id``, ``text``, ``t1``, ``t2``)."""
    spark = docs.sparkSession
    store = LineRuns(spark, intermediate_path(spark, "line_runs"), fanout)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)])).first()[0] or []
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, i).otherwise(batch)
    batch_keys(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(keys_path)
    for b in range(len(cuts) + 1):
        # rows of one doc_id are one document
        store.add(spark.read.schema(KEYS).parquet(keys_path).where(F.col("batch") == b).select("k1", "k2", "doc_id").distinct())
    return store.state().where(F.col("n_docs") >= min_docs).select("k1", "k2", "last_doc")


def without(lines: Column, places: Column) -> Column:
    """``lines`` less those at the sorted ``places``: the runs between them, one after the other."""
    def run(j: Column) -> Column:
        begin = F.when(j == 0, 1).otherwise(F.get(places, j - 1) + 2)
        end = F.coalesce(F.get(places, j) + 1, F.size(lines) + 1)
        return F.slice(lines, begin, end - begin)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), run))


def deduplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 3) -> DataFrame:
    """``docs`` with ``text`` reduced to the remaining lines (joined by \\n) and a struct
    ``_lines`` more: ``n_lines`` before dropping and ``n_dropped``.  Lines whose key has at least
    ``min_chars`` code points and lies in at least ``min_docs`` documents go, except in
    the largest ``doc_id`` that holds them."""
    spark = docs.sparkSession
    texts = doc_texts(docs)
    texts = texts.withColumns(text_key(F.col("text")))
    keys_path = intermediate_path(spark, "line_keys")
    repeated = repeated_lines(texts, keys_path, min_chars, min_docs, batches, fanout)
    drops = (spark.read.schema(KEYS).parquet(keys_path).join(repeated, ["k1", "k2"])
             .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
             .groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("gone"))
             .select(F.col("doc_id").alias("drop_id"), F.col("t1").alias("drop_1"), F.col("t2").alias("drop_2"), "gone"))
    text = F.col("row.text").cast("string")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inner = inner.select("row", F.col("row.doc_id").cast("long").alias("id"), *[c.alias(n) for n, c in text_key(text).items()])
    joined = inner.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t1") == F.col("drop_1")) & (F.col("t2") == F.col("drop_2")), "left")
    kept = F.when(F.col("gone").isNotNull(), F.array_join(without(F.col("lines"), F.col("gone")), "\n")).otherwise(F.col("row.text"))
    counts = F.struct(F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return (joined.select("row", "gone", lines_of(text).alias("lines"))
            .select(*[kept.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns], counts.alias(COUNTS)))


def line_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of the line deduplication of ``docs``."""
    return deduplicate_lines(doc_texts(docs)).select(
        "doc_id", f"{COUNTS}.n_lines", f"{COUNTS}.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
