"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised alike (A-Z lower-cased, runs of ASCII punctuation
and blanks one blank) and compared as UTF-8 bytes.  An item of m bytes that occurs in a
document with at most k edits shares at least ``m + 1 - q (k + 1)`` of its q-grams with it,
all on diagonals (document place less item place) at most k apart.  So the shared q-grams
are counted in bands of ``2 (k + 1)`` diagonals that overlap by half; bands that reach
the bound are verified by an alignment confined to the band.  A document is reported for
an item if the whole item occurs in it with at most k = ``max_edits`` x m edits.  Items too
short for a q-gram allow no edit and are looked for as they are.

A place of a text counts once for a band, however often its q-gram is in the item: of the
places of a q-gram in an item that lie in one cell of diagonals only the first and last are
indexed, and the shared q-grams of a text are counted in pieces, so periodic texts and
items need bounded memory.

The items are the query set: they go to the tasks in blocks of at most ``block_bytes``
bytes, each block meets every document, and documents are never compared with each other.

Results for odd input: null and empty texts match nothing; items that are null, or empty
when normalised, are ignored; items of equal text are each reported; equal documents
are each reported; a null ``doc_id`` is kept; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bytes, row_slices, worker_state

Q = 10
MAX_EDITS = 0.07
#: Normalised items that go to the tasks at once, in bytes.
BLOCK_BYTES = 4 << 20
#: Texts looked through at once, in rows; long texts make up their own group.
ROWS_AT_ONCE = 256

#: Shared q-grams counted at once.
POSTINGS_AT_ONCE = 1 << 20
_SLOT_BITS = 22
_OFFSET = 1 << 24


#: A-Z to a-z; other ASCII than letters and digits to blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: bytes | str | None) -> bytes:
    data = text.encode() if isinstance(text, str) else text
    return b" ".join(data.translate(_TABLE).split()) if data else b""


def qgram_keys(data: bytes) -> np.ndarray:
    """A 64-bit key of the Q bytes at every place (the last places reach into padding)."""
    n = len(data)
    padded = data + b"\0" * 32
    eight = np.empty((n // 8 + 3) * 8, np.uint64)
    for o in range(8):
        view = np.frombuffer(padded, "<u8", (len(padded) - o) // 8, o)
        target = eight[o::8]
        size = min(len(view), len(target))
        target[:size] = view[:size]
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[Q - 8:n + Q - 8] * np.uint64(0xC2B2AE3D27D4EB4F)


class Index:
    """Q-grams of a block of items and where they are."""

    def __init__(self, items: list[tuple[int, bytes]], max_edits: float):
        self.items = [(i, t) for i, t in items if len(t) >= Q]
        size = np.array([len(t) for _, t in self.items], np.int64)
        # the bound must stay positive: short items are allowed fewer edits
        self.edits = np.minimum((size * max_edits).astype(np.int64), size // Q - 1)
        self.bound = size + 1 - Q * (self.edits + 1)
        self.step = self.edits + 1
        keys = [qgram_keys(t)[:len(t) - Q + 1] for _, t in self.items]
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        order = np.lexsort((place, item, every))
        every, item, place = every[order], item[order], place[order]
        # the q-gram at a text's place meets two cells at most through a run of item places as long as
        # a cell: its first and its last place tell which
        run = place // self.step[item] if len(item) else place
        begins = np.ones(len(every), bool)
        begins[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1]) | (run[1:] != run[:-1])
        ends = np.append(begins[1:], True)[:len(begins)]
        keep = begins | ends
        every, self.item, self.place = every[keep], item[keep], place[keep]
        self.keys, self.first = np.unique(every, return_index=True)
        self.first = np.append(self.first, len(every))
        self.slots = np.zeros(1 << _SLOT_BITS, bool)
        self.slots[(self.keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True
        self.short = [(len(self.items) + j, t) for j, (_, t) in enumerate((i, t) for i, t in items if 0 < len(t) < Q)]
        self.items += [(i, t) for i, t in items if 0 < len(t) < Q]

    def cells(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """((item, cell of diagonals) as one number in order, places of ``data`` that share a q-gram there)."""
        none = np.zeros(0, np.int64)
        keys = qgram_keys(data)
        at = np.flatnonzero(self.slots[(keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return none, none
        found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        true = self.keys[found] == keys[at]
        at, found = at[true], found[true]
        uses = self.first[found + 1] - self.first[found]
        total, cell, count = np.cumsum(uses), none, none
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + POSTINGS_AT_ONCE, "right")))
            use = uses[a:b]
            posting = np.repeat(self.first[found[a:b]] - (np.cumsum(use) - use), use) + np.arange(int(use.sum()))
            item = self.item[posting]
            place = np.repeat(at[a:b], use)
            own = (item << 40) + (place - self.place[posting] + _OFFSET) // self.step[item]
            # a place counts once for a cell
            order = np.lexsort((place, own))
            own, place = own[order], place[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1])
            own, n = np.unique(own[new], return_counts=True)
            cell, back = np.unique(np.concatenate([cell, own]), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, n]), len(cell)).astype(np.int64)
            a = b
        return cell, count

    def bands(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(item, least diagonal) of every band that reaches its item's bound."""
        cell, count = self.cells(data)
        if not len(cell):
            return
        item = cell >> 40
        beside = np.append(cell[1:] == cell[:-1] + 1, False)      # the cell above holds q-grams too
        above = count + np.where(beside, np.append(count[1:], 0), 0)
        alone = ~np.concatenate([[False], beside[:-1]])            # the cell below holds none
        low = (cell & ((1 << 40) - 1)) * self.step[item] - _OFFSET
        enough = above >= self.bound[item]
        yield from zip(item[enough].tolist(), low[enough].tolist())
        enough = alone & (count >= self.bound[item])
        yield from zip(item[enough].tolist(), (low - self.step[item])[enough].tolist())


def align(item: bytes, text: bytes, low: int, width: int, limit: int) -> tuple[int, int] | None:
    """(edits, end in ``text``) of the best place of the whole item in ``text`` with all its
    diagonals in [low, low + width), or None beyond ``limit`` edits."""
    m = len(item)
    begin, end = low, low + width + m
    region = b"\0" * max(0, -begin) + text[max(0, begin):max(0, end)]
    region += b"\0" * (end - begin - len(region))
    found = _align(item, region, width, limit)
    return found and (found[0], min(low + found[1] + m, len(text)))


@lru_cache(maxsize=512)
def _align(item: bytes, region: bytes, width: int, limit: int) -> tuple[int, int] | None:
    """(edits, diagonal) of the best place; periodic texts ask for the same regions again and again."""
    y = np.frombuffer(region, np.uint8)
    ramp = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, c in enumerate(item):
        new = row + (y[i:i + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > limit:
            return None
    best = int(row.argmin())
    return int(row[best]), best


def matches(texts: list[bytes], index: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, end) of the best match of every text and item that match."""
    data = b"\n".join(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for j, low in index.bands(data):
        item, width = index.items[j][1], 2 * int(index.step[j])
        first = max(0, int(np.searchsorted(starts, low, "right")) - 1)
        last = max(first, int(np.searchsorted(starts, low + width + len(item), "right")) - 1)
        for d in range(first, min(last, len(texts) - 1) + 1):
            known = best.get((d, j))
            if known and known[0] == 0:
                continue
            own = low - int(starts[d])
            at = texts[d].find(item, max(0, own), max(0, own + width + len(item)))
            found = (0, at + len(item)) if at >= 0 else align(item, texts[d], own, width, int(index.edits[j]))
            if found and found[0] <= index.edits[j] and (known is None or found < known):
                best[d, j] = found
    for d, text in enumerate(texts):
        for j, item in index.short:
            at = text.find(item)
            if at >= 0:
                best[d, j] = (0, at + len(item))
    return [(d, j, e, end) for (d, j), (e, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The normalised items, in blocks of about ``block_bytes`` bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield sorted(((r.item_id, normalise(r.text)) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of at most about a million bytes, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 1 << 20:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def _batch_matches(column: pa.Array, index: Index) -> list[tuple[int, int, int, int]]:
    texts = [normalise(t) for t in column.to_pylist()]
    return [(start + d, j, e, end) for start, some in _groups(texts) for d, j, e, end in matches(some, index)]


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(``doc_id``, ``item_id``, ``edits``, ``match_end``, ``item_bytes``): a row for every document
    and item it holds; ``match_end`` is the end of the best match in the normalised text."""
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = worker_state("decontam:index", lambda: Index(shared.value, max_edits), (tuple(shared.value), max_edits))
            for batch in row_slices(batches, ROWS_AT_ONCE):
                found = _batch_matches(batch.column(1), index)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                     pa.array([index.items[f[1]][0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                     pa.array([f[3] for f in found], pa.int64()), pa.array([len(index.items[f[1]][1]) for f in found], pa.int64())],
                    ["doc_id", "item_id", "edits", "match_end", "item_bytes"])
        rows = doc_bytes(docs).mapInArrow(run, "doc_id long, item_id long, edits long, match_end long, item_bytes long")
        out = rows if out is None else out.unionByName(rows)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item."""
    at = [c.lower() for c in docs.columns].index("text")
    for block in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = worker_state("decontam:index", lambda: Index(shared.value, max_edits), (tuple(shared.value), max_edits))
            for batch in row_slices(batches, ROWS_AT_ONCE):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _batch_matches(batch.column(at), index)]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
