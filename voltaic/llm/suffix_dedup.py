"""Removal of byte strings that occur twice, by merged Burrows-Wheeler transforms.

Every string of ``length`` bytes that starts at more than one place of the corpus is
found, and all bytes such strings cover are removed.

1. Segments.  A string's anchor is the least-hashed of its ``ANCHOR``-byte grams, so equal
   strings have equal anchors at equal places.  Runs of strings that share an anchor form
   a segment (about 280 bytes); equal strings lie in segments of equal anchor hash.  Only
   hashes and places are shuffled; anchors met once drop out, and equal segments (copied
   documents) are counted instead of carried along.
2. Shards.  The bytes of the distinct segments of the remaining anchors meet by anchor.  A
   task packs whole anchors into groups, a group's segments into shards, sorts each
   shard's rotations and keeps its Burrows-Wheeler transform (symbols of 8 bytes).
3. Merge.  The shards' transforms are merged by iterative interleave refinement: the
   interleave of all rows is read in order, each row's symbol is taken from its shard's
   transform, and a stable sort by symbol gives the interleave that is right for 8 bytes
   more.  The round in which two neighbours part gives their common prefix; neighbours that
   never part in ``length / 8`` rounds start equal strings.  No suffix is sorted anew.

An anchor with over ``max_distinct`` different segments (a passage that a large share of all
documents embeds) would make one task's group too large, so it is split: its segments are
cut, at the same places counted from the anchor, into pieces of few strings each, and
pieces meet by the bytes that all strings of such a piece share.  Equal strings lie in
pieces of one group; pieces met once drop out.  Groups still too large are split again, into
pieces of 16, 4 and 2 strings; pieces of two strings of a group differ in two bytes.

Results for odd input: a null text is empty; empty and short texts lose nothing; equal rows
lose the same bytes (all strings of at least ``length`` bytes occur twice); a null ``doc_id``
is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.session import materialize

from .common import row_key, row_slices

LENGTH = 200
ANCHOR = 48
SYMBOL = 8
#: Bytes of text hashed at once, of a group whose shards are merged, and of a shard.
CHUNK_BYTES = 1 << 20
GROUP_BYTES = 48 << 10
SHARD_BYTES = 12 << 10
#: Different segments of an anchor that are merged as one group.
MAX_DISTINCT = 2_000
#: Strings in a piece of a split anchor, from one split to the next.
WIDTHS = (16, 4, 2)
_MASK = (1 << 64) - 1


def eight_bytes(data: bytes) -> np.ndarray:
    """The 8 bytes from every place on as one number (zeros beyond the end)."""
    n = len(data)
    padded = data + b"\0" * 16
    out = np.empty((n // 8 + 1) * 8, np.uint64)
    for o in range(8):
        out[o::8] = np.frombuffer(padded, "<u8", n // 8 + 1, o)
    return out[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    grid = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    grid[:len(values)] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from every place on."""
    eight = eight_bytes(data)
    grams = len(data) - ANCHOR + 1
    gram = np.zeros(grams, np.uint64)
    for j in range(0, ANCHOR, 8):
        gram = (gram ^ eight[j:j + grams]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    return gram


def anchor_place(string: bytes) -> int:
    """Where the anchor of one string lies: its least-hashed gram, the first of equals."""
    return int(np.argmin(gram_hashes(string) >> np.uint64(24)))


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, segment hash, start, size) of the segments of all texts."""
    import xxhash
    data = b"".join(texts)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
    if len(data) < length:
        return none
    gram = gram_hashes(data)
    grams = len(gram)
    packed = (gram & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)  # 40 bits of hash, then the place
    anchor = (sliding_min(packed, length - ANCHOR + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    whole = np.flatnonzero(sizes >= length)
    valid = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(valid, begins[whole], 1)
    np.add.at(valid, begins[whole] + sizes[whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(starts):
        return none
    same = anchor[starts]
    cut = np.flatnonzero((same[1:] != same[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = starts[np.concatenate([[0], cut])]
    last = starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    size = last - first + length
    digest = xxhash.xxh64_intdigest
    seg = np.array([digest(data[a:a + n]) for a, n in zip(first.tolist(), size.tolist())], np.uint64)
    text = np.searchsorted(begins, first, "right") - 1
    # texts of no bytes share their begin with the next one: the last of them is the right one
    return text, gram[anchor[first]].view(np.int64), seg.view(np.int64), (first - begins[text]).astype(np.int32), size.astype(np.int32)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def _long_segments(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of one text; parts of a very long one overlap so that no string is missed.
    A segment cut at a part's border is found in two pieces, which does no harm."""
    part = 8 * CHUNK_BYTES
    for at in range(0, max(1, len(text) - length + 1), part):
        t, h, s, start, size = segments([text[at:at + part + length - 1]], length)
        yield t, h, s, start.astype(np.int64) + at, size


def shard_order(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """The rotations of a shard's segments in order of their first ``length`` bytes.
    ``symbols``: rank of the 8 bytes at each place; begin, size: of the place's segment."""
    place = np.arange(len(symbols)) - begin
    rank, depth = symbols.astype(np.int64), SYMBOL
    while depth < length:
        step = min(depth, length - depth)
        ahead = begin + (place + step) % size
        rank = _dense(rank, rank[ahead])
        depth += step
    return np.argsort(rank, kind="stable")


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (high, low), both below 2^31."""
    return np.unique((high << 32) | low, return_inverse=True)[1].astype(np.int64)


def merged_classes(pieces: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, ...]:
    """(piece, offset, class, prefix) of every place of every piece, merged over shards:
    places of one class start equal strings of ``length`` bytes (read around the piece's
    end); ``prefix`` is the rounds survived with the row above, in symbols."""
    data = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    begin, size = begins[piece], sizes[piece]
    place = np.arange(len(data)) - begin
    code = eight_bytes(data)
    raw = np.frombuffer(data, np.uint8)
    wrap = np.flatnonzero(place > size - SYMBOL)
    around = begin[wrap, None] + (place[wrap, None] + np.arange(SYMBOL)) % size[wrap, None]
    code[wrap] = np.ascontiguousarray(raw[around]).view("<u8").ravel()
    distinct, symbols = np.unique(code, return_inverse=True)
    symbols = symbols.astype(np.uint16 if len(distinct) <= 1 << 16 else np.int32)
    behind = symbols[begin + (place - SYMBOL) % size]                       # the symbol before each place

    # shards of whole pieces: the order of each one's rows, and its transform
    shard_of = np.minimum((begins + sizes - 1) // max(shard_bytes, -(-len(data) // 250)), 255).astype(np.uint8)
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1]])), [len(pieces)]])
    rows, shard = [], []
    for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        lo, hi = begins[a], begins[b - 1] + sizes[b - 1]
        rows.append(lo + shard_order(symbols[lo:hi], begin[lo:hi] - lo, size[lo:hi], length))
        shard.append(np.full(hi - lo, s, np.uint8))
    rows, interleave = np.concatenate(rows), np.concatenate(shard)
    transform = behind[rows]

    block = np.zeros(len(data), np.int64)
    prefix = np.full(len(data), length // SYMBOL, np.int16)
    symbol = np.empty_like(transform)
    for depth in range(length // SYMBOL):
        symbol[np.argsort(interleave, kind="stable")] = transform
        order = np.argsort(symbol, kind="stable")
        interleave, block, symbol_now = interleave[order], block[order], symbol[order]
        parted = np.concatenate([[True], (symbol_now[1:] != symbol_now[:-1]) | (block[1:] != block[:-1])])
        prefix[parted & (prefix == length // SYMBOL)] = depth
        block = np.cumsum(parted) - 1
        if parted.all():
            break
    at = np.empty(len(data), np.int64)
    at[np.argsort(interleave, kind="stable")] = rows
    return piece[at], place[at], block, prefix


def repeated_runs(pieces: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last): runs of places where strings start that occur twice or more;
    ``counts`` are the pieces' occurrences."""
    piece, place, block, _ = merged_classes(pieces, length)
    sizes = np.array([len(p) for p in pieces])
    real = place + length <= sizes[piece]
    piece, place, block = piece[real], place[real], block[real]
    total = np.bincount(block, weights=counts[piece], minlength=1)
    again = total[block] >= 2
    key = np.sort((piece[again] << 32) | place[again])
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero(key[1:] != key[:-1] + 1) + 1
    first, last = key[np.concatenate([[0], cut])], key[np.concatenate([cut - 1, [len(key) - 1]])]
    return first >> 32, first & 0xFFFFFFFF, last & 0xFFFFFFFF


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a key (``k1``, ``k2``) without nulls; rows of equal key are equal."""
    return row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")))


def segment_table(docs: DataFrame, length: int) -> DataFrame:
    """(``h``, ``seg``, ``k1``, ``k2``, ``starts``, ``size``) of all segments of keyed documents;
    a text that repeats a segment (periodic text) has one row with all its starts."""
    names = ["h", "seg", "k1", "k2", "starts", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            texts = batch.column(1).to_pylist()
            for at, some in _chunks(texts):
                parts = _long_segments(some[0], length) if len(some) == 1 else [segments(some, length)]
                for text, h, seg, start, size in parts:
                    order = np.lexsort((start, seg, h, text))
                    text, h, seg, start, size = text[order], h[order], seg[order], start[order], size[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])
                    first = np.flatnonzero(new)
                    row = pa.array(text[first] + at)
                    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(start, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[first]), pa.array(seg[first]), batch.column(2).take(row), batch.column(3).take(row),
                         starts, pa.array(size[first], pa.int32())], names)
    return docs.mapInArrow(run, "h long, seg long, k1 long, k2 long, starts array<int>, size int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """(``k1``, ``k2``, ``lo``, ``hi``): byte spans of keyed documents to remove; they may overlap.

    Equal segments are counted before they meet (partial aggregation), so a segment that a
    third of all documents hold is one row per task; its documents find its count by a join,
    whose large keys are split at run time.  Segments of anchors over ``max_distinct`` go
    through the same steps again in smaller pieces."""
    sources = docs.select("k1", "k2", F.lit(0).alias("base"), F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("copies"), "text")
    rows = segment_table(docs, length).select("h", "seg", "k1", "k2", F.lit(0).alias("base"), "starts", "size", F.size("starts").cast("long").alias("weight"))
    out, by_anchor = None, Window.partitionBy("h")
    for width in (None, *WIDTHS):
        if width:
            rows = sources.mapInArrow(_split(width, length), "h long, seg long, k1 long, k2 long, base int, starts array<int>, size int, weight long")
        met = (rows.groupBy("h", "seg").agg(F.sum("weight").alias("copies"))
               .withColumn("met", F.sum("copies").over(by_anchor)).withColumn("different", F.count("*").over(by_anchor))
               .where("met > 1").select("h", "seg", "copies", "different"))
        met = materialize(met, "suffix_anchors")
        placed = materialize(rows.join(met, ["h", "seg"]), "suffix_segments")
        copied = placed.where("copies > 1").select("k1", "k2", "base", F.explode("starts").alias("start"), "size").select(
            "k1", "k2", (F.col("base") + F.col("start")).alias("lo"), (F.col("base") + F.col("start") + F.col("size")).alias("hi"))

        # of each distinct segment of an anchor that has several, one document lends the bytes
        hot = (F.col("different") > max_distinct) & F.lit(width != WIDTHS[-1])
        lent = (placed.where("different > 1").groupBy("h", "seg")
                .agg(F.min(F.struct("k1", "k2", "base", F.col("starts")[0].alias("start"), "size", "copies", hot.alias("hot"))).alias("r")))
        wanted = lent.select("h", "r.*").groupBy("k1", "k2", "base").agg(F.collect_list(F.struct("h", "copies", "start", "size", "hot")).alias("want"))
        sliced = sources.drop("h", "copies").join(wanted, ["k1", "k2", "base"]).select("k1", "k2", "base", "text", "want").mapInArrow(
            _slices, "h long, copies long, k1 long, k2 long, start int, hot boolean, bytes binary")
        sliced = materialize(sliced, "suffix_pieces")
        merged = (sliced.where(~F.col("hot")).drop("hot").repartition("h").sortWithinPartitions("h")
                  .mapInArrow(_merge_pieces(length), "k1 long, k2 long, lo int, hi int"))
        spans = copied.unionByName(merged)
        out = spans if out is None else out.unionByName(spans)
        sources = sliced.where("hot").select("k1", "k2", F.col("start").alias("base"), "h", "copies", F.col("bytes").alias("text"))
        if sources.isEmpty():
            break
    return out


def _split(width: int, length: int):
    """Cuts segments of hot anchors into pieces of at most ``width`` strings: piece b holds the
    strings that start b x ``width`` to (b + 1) x ``width`` - 1 bytes from the anchor.  Pieces meet by
    their anchor, b, and the bytes that are in all strings of a whole piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        digest = xxhash.xxh64_intdigest
        for batch in row_slices(batches, 256):
            rows = []
            for k1, k2, base, h, copies, data in zip(*(c.to_pylist() for c in batch.columns)):
                anchor, last = anchor_place(data[:length]), len(data) - length
                for b in range(-anchor // width, (last - anchor) // width + 1):
                    at = anchor + b * width
                    lo, hi = max(0, at), min(last, at + width - 1)
                    core = data[at + width - 1:at + length]
                    rows.append((digest(core, (h ^ b * 0x9E3779B97F4A7C15) & _MASK), digest(data[lo:hi + length]), k1, k2, base, [lo], hi - lo + length, copies))
            types = [pa.uint64(), pa.uint64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([c.view(pa.int64()) if i < 2 else c for i, c in enumerate(columns)],
                                             ["h", "seg", "k1", "k2", "base", "starts", "size", "weight"])
    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each document or piece (which begins at ``base``)."""
    names = ["h", "copies", "k1", "k2", "start", "hot", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in row_slices(batches, 256):
        rows = []
        for k1, k2, base, data, want in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(w["h"], w["copies"], k1, k2, base + w["start"], w["hot"], data[w["start"]:w["start"] + w["size"]]) for w in want]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _merge_pieces(length: int):
    """Merges groups of whole anchors, which arrive together, shard by shard."""
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        counts = np.array([r[1] for r in rows], np.int64)
        piece, first, last = repeated_runs([r[5] for r in rows], counts, length)
        single = counts[piece] == 1  # the spans of copied segments are known
        piece, first, last = piece[single].tolist(), first[single].tolist(), last[single].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[p][2] for p in piece], pa.int64()), pa.array([rows[p][3] for p in piece], pa.int64()),
             pa.array([rows[p][4] + a for p, a in zip(piece, first)], pa.int32()),
             pa.array([rows[p][4] + b + length for p, b in zip(piece, last)], pa.int32())], ["k1", "k2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, anchor = [], 0, None
        for batch in row_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != anchor and size >= GROUP_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
                anchor = row[0]
                rows.append(row)
                size += len(row[5])
        if rows:
            yield flush(rows)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """One row per document: ``doc_id``, ``kept`` (binary: the remaining bytes), ``n_bytes``,
    ``n_removed`` and ``spans`` (maximal removed runs, begin and end)."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length, max_distinct).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    span_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 256):
            kept, sizes, runs = [], [], []
            for data, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                union: list[list[int]] = []
                for lo, hi in sorted((c["lo"], c["hi"]) for c in cut or ()):
                    if union and lo <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], hi)
                    else:
                        union.append([lo, hi])
                edges = [0, *(x for pair in union for x in pair), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(data))
                runs.append([{"lo": a, "hi": b} for a, b in union])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()), pa.array(runs, span_type)],
                ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "cut").mapInArrow(
        run, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>")


def removal_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of ``remove_repeats``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                       F.sha2("kept", 256).alias("kept_sha256"))
