"""Token ids in ORC: whole texts encoded, an end id appended, written in ``doc_id`` order.

Layout: one row per document in ascending ``doc_id`` order over the files (ties by text),
``ids`` as ``array<int>`` (integer run-length encoding), row indexes every
``row_stride`` rows and a Bloom filter on ``doc_id``.  ``part`` and ``before`` (tokens of
earlier rows of the same file) let a reader find any document's place in the stream
from one sum per file; stripes are read in parallel, and filters on ``doc_id`` skip files,
stripes and row groups by their statistics and Bloom filters.

Results for odd input: a null or empty text holds the end id alone; the strings of the
tokenizer's added tokens in a text are those tokens, as the library has it; a null ``doc_id``
comes first; equal rows are each written; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaic.session import min_partitions

from .common import doc_bytes, row_slices, worker_state
from .segments import Known, distinct, groups, segment_owners, starts, sums

#: Bytes of text that are encoded together.
GROUP_BYTES = 8 << 20
#: Distinct segments whose ids a worker keeps.
KEPT_SEGMENTS = 800_000
#: Bytes of text that a file holds at most, about.
FILE_BYTES = 64 << 20
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.stripe.size": str(64 << 20), "compression": "zstd"}


class Encoder:
    """The tokenizers library over whole texts.  Its words never span two segments and its
    normaliser composes nothing across two ASCII characters, so a text's ids are those of
    its segments in order, and each distinct segment goes to the library once.  A text that holds the string of an added token is encoded whole."""

    def __init__(self, tokenizer_file: str, kept: int = KEPT_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.known = Known(kept)
        self.added = [str(t.content).lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<i4")

    def _segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each segment, all ids): many go as one text, blanks between them, and the
        ids are dealt back by their offsets."""
        sizes, values = [], []
        for at in range(0, len(segments), 512):
            some = [s.decode() for s in segments[at:at + 512]]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0] + [len(s) + 1 for s in some])
            sizes.append(np.diff(np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), begins)))
            values.append(np.array(e.ids, "<i4"))
        return np.concatenate(sizes), np.concatenate(values)

    def encode(self, texts: list[bytes | None], group_bytes: int = GROUP_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in order)."""
        lower = [t.lower() if t else b"" for t in texts]
        special = [i for i, t in enumerate(lower) if any(a in t for a in self.added)]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for i in special:
            found[i].append(self.whole(texts[i]))
            lower[i] = b""
        for rows, held in groups(lower, group_bytes):
            lengths = np.array([len(h) for h in held])
            data = b"".join(held)
            at = starts(data, np.cumsum(lengths) - lengths)
            which, segments = distinct(data, at)
            counts, ids = self.known.look_up(segments, which, self._segments)
            each = sums(counts, segment_owners(lengths, at), len(held))
            for i, part in zip(rows, np.split(ids, np.cumsum(each)[:-1])):
                found[i].append(part)
        counts = np.array([sum(map(len, f)) for f in found], np.int64)
        return counts, np.concatenate([p for f in found for p in f] or [np.zeros(0, "<i4")])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, partitions: int | None = None,
                 row_stride: int = 1000, group_bytes: int = GROUP_BYTES) -> None:
    """Encode every whole text and write the ORC files under ``path``, one for ``FILE_BYTES`` of
    text, and enough for every core."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("part", pa.int32()), ("before", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = worker_state(f"token_orc:{tokenizer_file}", lambda: Encoder(tokenizer_file))
        part, before = TaskContext.get().partitionId(), 0
        for batch in row_slices(batches, 2048):
            counts, ids = encoder.encode(batch.column(1).to_pylist(), group_bytes)
            ends = np.cumsum(counts)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            ids = np.insert(ids, ends, end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                 pa.array(np.full(len(counts), part), pa.int32()), pa.array(before + offsets[:-1])], schema=schema)
            before += int(offsets[-1])

    texts = doc_bytes(docs)
    n = partitions or max(min_partitions(docs.sparkSession), (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)
    ordered = texts.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(run, "doc_id long, ids array<int>, part int, before long")
     .write.mode("overwrite").options(**ORC_OPTIONS).option("orc.row.index.stride", row_stride).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(``doc_id``, ``ids``, ``part``, ``before``); a ``doc_id`` prunes by the files' metadata."""
    rows = spark.read.orc(path)
    return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: ``start`` in the whole stream, ``n_tokens``, ``ids_crc32``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        for batch in batches:
            ids = batch.column(1)
            offsets = ids.offsets.to_numpy()
            values = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)],
                ["doc_id", "n_tokens", "ids_crc32", "part", "before"])

    rows = read_tokens(spark, path).select("doc_id", "ids", "part", "before").mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, part int, before long")
    # one row a file: its tokens, and those of all files before
    totals = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("before") + F.size("ids")).alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
