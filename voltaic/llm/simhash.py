"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``max_bits`` bits share a variant within half of that
distance of each, and any two that share such a variant are within ``max_bits``.  So
every fingerprint emits its ball of variants, one shuffle brings equal variants
together, and each member is linked to the least of its bucket: a star of true links,
never all pairs.  A bucket holds at most as many fingerprints as a ball has variants.

The balls are large (2,081 variants for 4 bits), so the same idea first runs with one of
three blocks of bits left out.  Of ``max_bits`` differing bits, the block that holds most
has at least a third, so the other two blocks (42 or 43 bits) differ in at most two thirds,
and a ball of half of that radius around them (44 variants for 4 bits, three times) meets.
Fingerprints that meet no other there have no neighbour and are spared the full ball; no
link is lost.  Unrelated fingerprints rarely meet on 42 bits, so the full balls stay a share
of the near duplicates, not of the table.

Results for odd input: a null or blank text has fingerprint 0 and is linked like any
other; equal rows share fingerprint and component; a null ``doc_id`` is kept and never
is a component id unless every id of the component is null; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.session import materialize, min_partitions

from .common import connected_components, doc_bytes, row_key, row_slices


def fingerprint(text: bytes | None, shingle_words: int) -> int:
    """64-bit SimHash of the word shingles (XXH64, seed 42), as a signed long."""
    import xxhash
    words = text.lower().split() if text else []
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    if n <= 1:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:n - 1]]
        shingles = [joined[a:b - 1] for a, b in zip(starts, ends[shingle_words - 1:])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ bits for j in range(8)])
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(``doc_id``, ``k1``, ``k2``, ``fp`` signed long) of every whole text; k1 and k2 are its row key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            fps = [fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fps, pa.int64())], ["doc_id", "k1", "k2", "fp"])
    return row_key(doc_bytes(docs)).mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def ball_masks(bits: int, radius: int) -> list[int]:
    """Every mask of at most ``radius`` set bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in itertools.combinations(range(bits), r)]
    return [_signed(m) for m in masks]


def _literal(masks: list[int]):
    return F.from_json(F.lit("[" + ",".join(map(str, masks)) + "]"), "array<bigint>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: First bits of the three blocks, and the end.
BLOCKS = (0, 21, 42, 64)


def with_neighbours(fps: DataFrame, max_bits: int) -> DataFrame:
    """The distinct fingerprints that may have another within ``max_bits`` bits."""
    rest = max_bits - -(-max_bits // 3)
    keys = []

    def ball(b: int, centre, masks: list[int]):
        return F.transform(_literal(masks), lambda m: F.struct(F.lit(b).alias("b"), centre.bitwiseXOR(m).alias("key")))

    for b, (lo, hi) in enumerate(zip(BLOCKS, BLOCKS[1:])):
        out = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        bits = [i for i in range(64) if not lo <= i < hi]
        masks = [_signed(sum(1 << i for i in chosen)) for r in range((rest + 1) // 2 + 1) for chosen in itertools.combinations(bits, r)]
        keys.append(ball(b, F.col("fp").bitwiseAND(F.lit(_signed(~out & (1 << 64) - 1))), masks))
    by_key = Window.partitionBy("key", "b").orderBy("fp")
    # few bytes, but each row becomes a ball: dealt out to all tasks
    dealt = fps.repartition(min_partitions(fps.sparkSession), "fp")
    met = (dealt.select("fp", F.explode(F.concat(*keys)).alias("k")).select("fp", "k.b", "k.key")
           .select("fp", F.lag("fp").over(by_key).alias("before"), F.lead("fp").over(by_key).alias("after")))
    return met.where("before is not null or after is not null").select("fp").distinct()


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (``u``, ``v``) of distinct fingerprints within ``max_bits`` bits whose
    connected components are those of all such pairs."""
    ball = _literal(ball_masks(64, (max_bits + 1) // 2))
    by_variant = Window.partitionBy("variant").orderBy("fp")
    met = with_neighbours(fps, max_bits).repartition(min_partitions(fps.sparkSession), "fp")
    return (met.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
            .select(F.first("fp").over(by_variant).alias("u"), F.col("fp").alias("v"))
            .where("u <> v").distinct()
            .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))


def clusters(docs: DataFrame, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all documents, and (``fp``, ``root``, ``first_id``) of the distinct ones:
    the least fingerprint of their component and their least ``doc_id``."""
    fps = materialize(fingerprints(docs, shingle_words), "simhash_fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash_distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits), "simhash_edges")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    return fps, materialize(rooted, "simhash_roots")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``
    (least ``doc_id`` reachable over links of at most ``max_bits`` differing bits)."""
    fps, rooted = clusters(docs, shingle_words, max_bits)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, all their columns, of one document per component: the least
    ``doc_id`` (nulls last)."""
    fps, rooted = clusters(docs, shingle_words, max_bits)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2"))
    first = (fps.groupBy("fp").agg(order.alias("o")).join(rooted, "fp").groupBy("root").agg(F.min("o").alias("o"))
             .select("o.k1", "o.k2"))
    rows = row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                               F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")))
    kept = rows.drop("doc_id", "text").join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
