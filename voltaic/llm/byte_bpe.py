"""Byte-level BPE encoding by ranked merges of distinct words, and decoding by pieces.

A text is cut into segments (``segments``) and these into the pre-tokenizer's matches
("words").  Each distinct word of a group of texts is encoded once: a word that is a piece
is that piece's id; the others are byte arrays that the rank map folds, always merging the
adjacent pair of least rank, leftmost first, for all words of a length together.  A text's
ids are its words' ids in order, one binary of little-endian unsigned 32-bit numbers.
Decoding concatenates the binary pieces of the ids, a higher-order function over a literal
array of the pieces.

Results for odd input: null and empty texts have no ids and decode to empty bytes;
equal rows have equal results; a null ``doc_id`` passes through; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bytes, row_slices, worker_state
from .segments import Known, distinct, groups, segment_owners, starts, sums, take

#: Bytes of text whose words are encoded together.
GROUP_BYTES = 2 << 20
#: Distinct segments whose ids a worker keeps.
KEPT_SEGMENTS = 100_000
#: Longer words (bytes) go through a heap, one by one (same merges, same ids).
LONG_WORD = 48
#: Stands for "no merge": above every rank.
NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file (base64 piece and id a line); its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long words: candidate pairs wait in a heap by (rank, place)."""
    import heapq
    n = len(word)
    end = list(range(1, n + 1))          # end of the part that begins at i
    before = list(range(-1, n - 1))      # begin of the part before
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and alive[j] and end[j] == stop):
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


#: White space beyond ASCII: the segments of such a text are its words.
ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class Merger:
    """The rank map as arrays: ids of single bytes, and a hash table of the pairs of pieces
    whose bytes together are a piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_SEGMENTS):
        import regex
        self.known = Known(kept)
        self.find, self.ranks = regex.compile(pattern).findall, ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[p[:i]] << 32) + ranks[p[i:]]: r for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
        self.shift = np.uint64(64 - max(10, (4 * len(pairs)).bit_length()))
        self.keys = np.full((1 << 64 - int(self.shift)) + len(pairs), -1, np.int64)
        self.merged = np.full(len(self.keys), NONE, np.int64)
        keys, merged = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(keys)
        while len(keys):                             # each free slot takes one of the keys that want it
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.merged[slot[taken]] = keys[taken], merged[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, merged, slot = keys[left], merged[left], slot[left] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NONE`` where there is none."""
        keys = ((left << 32) + right).ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.merged[slot], NONE)
        on = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[on]
        while len(on):
            slot = slot + 1
            held = self.keys[slot]
            hit = held == keys[on]
            out[on[hit]] = self.merged[slot[hit]]
            more = ~hit & (held >= 0)
            on, slot = on[more], slot[more]
        return out.reshape(left.shape)

    def fold(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(places in ``words``, their ids, a row a word)]: the merges of words of one length, all
        rows at once.  A merge shortens a row by one, so rows of a round have one width."""
        rows = np.arange(len(words))
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        done = []
        while ids.shape[1] > 1:
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            end = least == NONE
            if end.any():
                done.append((rows[end], ids[end]))
                rows, ids, rank, at, least = rows[~end], ids[~end], rank[~end], at[~end], least[~end]
            if not len(rows):
                return done
            width, every = ids.shape[1] - 1, np.arange(len(rows))
            ids = np.take_along_axis(ids, np.arange(width) + (np.arange(width) > at[:, None]), 1)
            ids[every, at] = least                   # a piece's id is its rank
            rank = np.take_along_axis(rank, np.arange(width - 1) + (np.arange(width - 1) >= at[:, None]), 1)
            for side in (0, 1):                      # the merged piece with its neighbour before and after
                left = at - 1 + side
                some = np.flatnonzero((left >= 0) & (left < width - 1))
                rank[some, left[some]] = self.rank(ids[some, left[some]], ids[some, left[some] + 1])
        done.append((rows, ids))
        return done

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each distinct word, all ids in order)."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        sizes = np.ones(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        lengths = np.array([len(w) for w in words])
        lengths[whole >= 0] = 0
        for length in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == length)
            if length > LONG_WORD:
                found += [(at[i:i + 1], np.array([_merge_long(words[j], self.ranks)])) for i, j in enumerate(at.tolist())]
            else:
                found += [(at[rows], ids) for rows, ids in self.fold([words[i] for i in at.tolist()])]
        for rows, ids in found:
            sizes[rows] = ids.shape[1]
        first = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[first[whole >= 0]] = whole[whole >= 0]
        for rows, ids in found:
            out[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return sizes, out

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each segment, all ids in order)."""
        texts = [s.decode() for s in segments]
        # one run of the pattern over all segments, a line end between them; white space is a word as it is
        plain = [t for t in texts if not t.isspace()]
        parts = iter(self.find("\n".join(plain) + "\n")) if plain else iter(())
        number: dict[str, int] = {}
        words, sizes = [], []
        for t in texts:
            own = [t] if t.isspace() else list(iter(parts.__next__, "\n"))
            sizes.append(len(own))
            words += [number.setdefault(w, len(number)) for w in own]
        counts, ids = self.encode_words([w.encode() for w in number])
        counts, ids = take(counts, ids, np.array(words, np.int64))
        return sums(counts, np.repeat(np.arange(len(sizes)), sizes), len(sizes)), ids

    def odd(self, text: bytes) -> bool:
        return any(b in text for b in _ODD_BYTES) and bool(ODD_SPACE.search(text.decode()))

    def encode(self, texts: list[bytes | None], group_bytes: int = GROUP_BYTES) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        found: list[list[bytes]] = [[] for _ in texts]

        def add(rows: list[int], held: list[bytes], at: np.ndarray, lengths: np.ndarray) -> None:
            which, segments = distinct(b"".join(held), at)
            counts, ids = self.known.look_up(segments, which, self.encode_segments)
            ends = 4 * np.cumsum(sums(counts, segment_owners(lengths, at), len(held)))
            packed = ids.astype("<u4").tobytes()
            for i, a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
                found[i].append(packed[a:b])

        odd = {i for i, t in enumerate(texts) if t and self.odd(t)}
        for i in odd:
            sizes = np.array([len(w.encode()) for w in self.find(texts[i].decode())])
            add([i], [texts[i]], np.cumsum(sizes) - sizes, np.array([len(texts[i])]))
        for rows, held in groups([None if i in odd else t for i, t in enumerate(texts)], group_bytes):
            lengths = np.array([len(h) for h in held])
            add(rows, held, starts(b"".join(held), np.cumsum(lengths) - lengths), lengths)
        return [b"".join(f) for f in found]


def encode(docs: DataFrame, rank_file: str, pattern: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(``doc_id``, ``ids`` binary, ``id_list`` array) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = worker_state(f"byte_bpe:merger:{rank_file}:{pattern}", lambda: Merger(shared.value, pattern))
        for batch in row_slices(batches):
            packed = merger.encode(batch.column(1).to_pylist(), group_bytes)
            ends = np.cumsum([0] + [len(b) // 4 for b in packed])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), lists], ["doc_id", "ids", "id_list"])
    return doc_bytes(docs).mapInArrow(run, "doc_id long, ids binary, id_list array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``, ``id_list``) with ``decoded`` for the list: the bytes of the ids' pieces."""
    pieces = {i: base64.b64encode(p).decode() for p, i in load_ranks(rank_file).items()}
    table = F.from_json(F.lit(json.dumps([pieces.get(i) for i in range(max(pieces) + 1)])), "array<binary>")   # folded to a literal
    # strings here are any bytes: joining them copies bytes
    decoded = F.array_join(F.transform("id_list", lambda i: F.get(table, i).cast("string")), "").cast("binary")
    return encoded.select("doc_id", "ids", decoded.alias("decoded"))


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of (``doc_id``, ``ids``, ``decoded``)."""
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
