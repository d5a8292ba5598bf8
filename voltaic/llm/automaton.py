"""Weighted acyclic automata over word sequences, in arrays.

An automaton holds ``depth``-word paths over a sorted vocabulary (label 0 ends a shorter
path) with a whole-number weight each.  It is built from sorted paths, level by level from
the last, and states of one level with equal right languages (same labels, same targets
or weights) are one state, so it is minimal.  The weight of a prefix is the sum over the
range of paths that begin with it.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np

#: Odd multipliers of the two hashes that propose equal states (each proposal is verified).
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(a: np.ndarray, b: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (a.astype(np.uint64) * by + b.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    return (h ^ h >> np.uint64(29)) * by


def _shared(first: np.ndarray, label: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each state, a state of each class): states whose arcs are equal share one.
    ``first`` has the states' arc offsets and the end."""
    sums = [np.add.reduceat(_mixed(label, value, by), first[:-1]) for by in _MIX]
    order = np.lexsort(sums)
    new = np.ones(len(order), bool)
    new[1:] = (sums[0][order][1:] != sums[0][order][:-1]) | (sums[1][order][1:] != sums[1][order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    chosen = order[new]
    # the hashes only propose: arcs are compared one by one with those of the class's state
    size = np.diff(first)
    model = chosen[kind]
    if (size == size[model]).all():
        twin = np.repeat(first[model] - first[:-1], size) + np.arange(len(label))
        if (label == label[twin]).all() and (value == value[twin]).all():
            return kind, chosen
    every = np.arange(len(size))
    return every, every


def _arcs_of(first: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(arc, index into ``states``) of all arcs of the states, in order."""
    size = first[states + 1] - first[states]
    source = np.repeat(np.arange(len(states)), size)
    ends = np.cumsum(size)
    return np.repeat(first[states] - (ends - size), size) + np.arange(len(source)), source


def sort_paths(paths: np.ndarray, labels: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct paths in order, their summed weights); without ``weight`` each row counts one."""
    depth, bits = paths.shape[1], max(1, int(labels).bit_length())
    if bits * depth <= 64:
        key = np.zeros(len(paths), np.uint64)
        for j in range(depth):
            key = key << np.uint64(bits) | paths[:, j].astype(np.uint64)
        if weight is None:
            key, summed = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key, weight = key[order], weight[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            key, summed = key[at], np.add.reduceat(weight, at) if len(at) else weight
        mask = np.uint64((1 << bits) - 1)
        cols = [(key >> np.uint64(bits * (depth - 1 - j)) & mask).astype(np.int32) for j in range(depth)]
        return np.stack(cols, 1) if len(key) else paths[:0], summed.astype(np.int64)
    order = np.lexsort([paths[:, j] for j in reversed(range(depth))])
    paths = paths[order]
    weight = np.ones(len(paths), np.int64) if weight is None else weight[order]
    at = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(1)))
    return paths[at], np.add.reduceat(weight, at)


class Automaton:
    """``words`` are the sorted labels (label i + 1 is words[i]); ``levels`` hold per level
    the arc offsets of the states, the arcs' labels, and their targets (weights at the last)."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], paths: np.ndarray, weight: np.ndarray) -> Automaton:
        """From distinct paths in order; only the words they use are kept."""
        used = np.unique(paths)
        used = used[used > 0]
        local = np.zeros(len(words) + 1, np.int32)
        local[used] = np.arange(1, len(used) + 1)
        paths = local[paths]
        depth, levels = paths.shape[1], []
        same = [np.zeros(len(paths), bool)]         # same[j]: as many as j first words equal the path's before
        for j in range(depth):
            more = np.zeros(len(paths), bool)
            more[1:] = paths[1:, j] == paths[:-1, j]
            same.append(more if j == 0 else more & same[-1])
        same[0][1:] = True
        value = weight
        for j in range(depth - 1, -1, -1):
            arcs = np.flatnonzero(~same[j + 1])      # a path that begins an arc of this level
            begins = np.flatnonzero(~same[j][arcs])
            first = np.append(begins, len(arcs))
            label = paths[arcs, j]
            kind, chosen = _shared(first, label, value)
            at, _ = _arcs_of(first, chosen)
            size = np.diff(first)[chosen]
            levels.append((np.append(0, np.cumsum(size)), label[at], value[at]))
            value = kind                              # targets of the arcs one level up
        return cls([words[i - 1] for i in used.tolist()], levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(all paths in order, their weights)."""
        states, cols = np.zeros(1, np.int64), []
        for first, label, value in self.levels:
            arc, source = _arcs_of(first, states)
            cols = [c[source] for c in cols] + [label[arc]]
            states = value[arc]
        return np.stack(cols, 1), states

    def weights_of(self, sequences: list[tuple[bytes, ...]]) -> np.ndarray:
        """Composition with a set of sequences: the weight of each one's own path (0: no such path)."""
        index = {w: i + 1 for i, w in enumerate(self.words)}
        depth, labels = len(self.levels), len(self.words) + 1
        want = np.zeros((len(sequences), depth), np.int64)
        alive = np.ones(len(sequences), bool)
        for i, seq in enumerate(sequences):
            at = [index.get(w, -1) for w in seq]
            alive[i] = len(at) <= depth and -1 not in at
            if alive[i]:
                want[i, :len(at)] = at
        state = np.zeros(len(sequences), np.int64)
        for j, (first, label, value) in enumerate(self.levels):
            keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * labels + label
            wanted = state * labels + want[:, j]
            arc = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            alive &= keys[arc] == wanted
            state = np.where(alive, value[arc], 0)
        return np.where(alive, state, 0)

    def to_bytes(self) -> bytes:
        """States as their numbers of arcs, every array in the least type that holds it."""
        small = [tuple(a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in (np.diff(first), label, value))
                 for first, label, value in self.levels]
        return pickle.dumps((self.words, small), protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        words, small = pickle.loads(data)
        return cls(words, [(np.append(0, np.cumsum(size, dtype=np.int64)), label.astype(np.int32), value.astype(np.int64))
                           for size, label, value in small])


def place(words: list[bytes], paths: np.ndarray, bound: tuple[bytes, ...]) -> int:
    """Number of paths (in order, labels of the sorted ``words``) before ``bound``."""
    low, high = 0, len(paths)
    for j, word in enumerate(bound):
        rank = bisect_left(words, word) + 1 if word else 0
        known = not word or rank <= len(words) and words[rank - 1] == word
        col = paths[low:high, j]
        low, high = low + int(np.searchsorted(col, rank)), low + int(np.searchsorted(col, rank, "right" if known else "left"))
        if not known:
            break
    return low


def union(parts: Iterable[Automaton]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, distinct paths in order, summed weights) of several automata."""
    parts = list(parts)
    words = sorted(set().union(*[a.words for a in parts]))
    index = {w: i + 1 for i, w in enumerate(words)}
    paths, weights = [], []
    for a in parts:
        own, weight = a.paths()
        paths.append(np.array([0] + [index[w] for w in a.words], np.int32)[own])
        weights.append(weight)
    return words, *sort_paths(np.concatenate(paths), len(words), np.concatenate(weights))


def prefix_sums(paths: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first path, summed weight) of every prefix of ``size`` words, paths that end before left out."""
    change = np.ones(len(paths), bool)
    change[1:] = (paths[1:, :size] != paths[:-1, :size]).any(1)
    at = np.flatnonzero(change)
    sums = np.add.reduceat(weight, at) if len(at) else weight
    whole = paths[at, size - 1] > 0
    return at[whole], sums[whole]
