"""Texts cut into segments that the tokenizers' patterns never join, without a Python object
for each: byte classes, offsets, and Arrow's dictionary of the distinct segments.

A segment begins where every pattern of the kind ``'s|...| ?letters| ?digits| ?others|\\s+(?!\\S)|\\s+``
begins a match: at a word (with the one blank before it), at a run of ASCII white space
and at its last character, and between ASCII letters, digits and punctuation.  No cut
follows an apostrophe, which may open a contraction, nor touches a byte beyond ASCII.
So the matches of a text are those of its segments, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_OTHER, _LETTER, _DIGIT, _PUNCT, _QUOTE, _BLANK, _SPACE = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for c in range(33, 127):
        out[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _PUNCT
    out[ord("'")] = _QUOTE
    out[[9, 10, 11, 12, 13]] = _SPACE
    out[32] = _BLANK
    return out


def _cuts() -> np.ndarray:
    """Whether a segment begins between two bytes, by 8 x class before + class after."""
    out = np.zeros(64, bool)
    for a, b in ((_LETTER, _DIGIT), (_LETTER, _PUNCT), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _PUNCT), (_DIGIT, _QUOTE), (_PUNCT, _LETTER), (_PUNCT, _DIGIT)):
        out[8 * a + b] = True
    for word in range(_BLANK):
        for space in (_BLANK, _SPACE):
            out[8 * word + space] = True
        out[8 * _SPACE + word] = True
    return out


_CLASS, _CUT = _classes(), _cuts()
#: A place to halve a long text: one blank or line end between two other characters.
_HALF = re.compile(rb"[^\s][ \n](?=[^\s])")


def starts(data: bytes, texts: np.ndarray) -> np.ndarray:
    """Places of ``data`` where segments begin; ``texts`` are the places where its (non-empty) texts do."""
    kind = _CLASS[np.frombuffer(data, np.uint8)]
    begins = np.zeros(len(kind), bool)
    begins[1:] = _CUT[kind[:-1] << 3 | kind[1:]]
    space = kind >= _BLANK
    last = space[:-1] & ~space[1:]                   # of a run that a word follows
    last[texts[1:] - 1] = False
    begins[:-1] |= last
    begins[texts] = True
    return np.flatnonzero(begins)


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes whose segments are the text's."""
    at = 0
    while at < len(text):
        cut = _HALF.search(text, at + size) if len(text) - at > size else None
        end = cut.start() + 1 if cut else len(text)
        yield text[at:end]
        at = end


def groups(texts: list[bytes | None], size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, their bytes) in runs of about ``size`` bytes: several texts, or a part of a long one.
    Rows without bytes are left out."""
    rows, held, total = [], [], 0
    for i, text in enumerate(texts):
        for part in parts(text, size) if text else ():
            rows.append(i)
            held.append(part)
            total += len(part)
            if total >= size:
                yield rows, held
                rows, held, total = [], [], 0
    if held:
        yield rows, held


def distinct(data: bytes, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each segment's bytes, the distinct segments)."""
    offsets = np.append(at, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def take(sizes: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (of ``sizes``, one after the other) in the order ``which``: (sizes, values)."""
    first, out = np.cumsum(sizes) - sizes, sizes[which]
    place = np.repeat(first[which] - (np.cumsum(out) - out), out) + np.arange(int(out.sum()))
    return out, values[place]


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by ``owner``, exact."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.searchsorted(owner, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def segment_owners(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each segment lies in."""
    return np.searchsorted(np.cumsum(lengths), at, "right")


class Known:
    """The ids of segments met before: the first ``limit`` of a worker's life are kept."""

    def __init__(self, limit: int):
        self.limit, self.number = limit, {}
        self.first, self.ids, self.n, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0

    def _keep(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Append runs of ids to the two arrays, which grow by doubling."""
        n, used = self.n + len(sizes), self.used + len(ids)
        while len(self.first) <= n:
            self.first = np.append(self.first, np.zeros_like(self.first))
        while len(self.ids) < used:
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.first[self.n + 1:n + 1] = self.used + np.cumsum(sizes)
        self.ids[self.used:used] = ids
        self.n, self.used = n, used

    def look_up(self, segments: list[bytes], which: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of the segments ``which`` numbers; ``encode`` gives those of new ones."""
        place = np.fromiter((self.number.get(s, -1) for s in segments), np.int64, len(segments))
        new = np.flatnonzero(place < 0)
        n, used = self.n, self.used
        if len(new):
            fresh = [segments[i] for i in new.tolist()]
            self._keep(*encode(fresh))
            place[new] = np.arange(n, self.n)
            stay = max(0, min(len(fresh), self.limit - n))
            self.number.update(zip(fresh[:stay], range(n, n + stay)))
        first = self.first[place]
        sizes = (self.first[place + 1] - first)[which]
        first = first[which]
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        ids = self.ids[at]
        if len(new) and n + stay < self.n:                # those beyond the limit are forgotten
            self.n, self.used = n + stay, int(self.first[n + stay])
        return sizes, ids
