"""Small tables and brute-force twins for the tests of the training-data operators."""

import collections
import hashlib
import itertools

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns a table may have besides its own, named as operators name theirs.
EXTRA = ["row", "k1", "k2", "fp", "ids", "part", "before", "h", "seg", "tokens", "key", "batch", "gone", "lines", "label", "stratum_", "id"]


def sample_texts():
    """Texts of SF in doc_id order, as (doc_id, text, lang)."""
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    return list(zip(d.doc_id.tolist(), d.text.tolist(), d.lang.tolist()))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long_line = "a line that is certainly longer than forty characters, repeated often"
    base = [
        (1, None, "en"), (2, "", "en"), (3, "word", None), (4, " \t\n ", "de"), (5, "x" * 70_000, "en"),
        (6, "one two three four five six " * 2000, "en"), (7, long_line, "en"), (7, long_line, "en"), (8, long_line, "fr"),
        (9, long_line + "\nother\n" + long_line.upper() + "  ", "fr"), (10, "\r\n" + long_line + "\r\n\x0b", "es"), (None, long_line, "en"),
        (None, None, None), (11, "ünïcödé 中文 🙂 12 #$%\x00\x1c\x85  end ", "en"), (12, "word", "en"), (-3, long_line, "en"),
    ]
    return [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in base]


def odd_docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit(c) for c in EXTRA})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def removed_brute(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha256) of each text when repeated strings go."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        covered = np.zeros(len(t) + 2, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                covered[i + 1] += 1
                covered[i + length + 1] -= 1
        covered = np.cumsum(covered)[:len(t) + 1] > 0
        kept = bytes(b for b, c in zip(t, covered[1:]) if not c)
        out.append((len(t), int(covered.sum()), int((covered[1:] & ~covered[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def simhash_brute(text, k=4):
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(fps, max_bits):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= max_bits:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def lines_brute(rows, min_chars=40, min_docs=5):
    """(n_lines, n_dropped, kept text) of rows (doc_id, text)."""
    blanks = " \t\n\x0b\f\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blanks))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            last = max((x for x in holders[k] if x is not None), default=None)
            if len(k) < min_chars or len(holders[k]) < min_docs or i == last:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def edits_brute(item, text):
    """Least edits that make ``item`` a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def langid_brute(text, model):
    """(language, cosine, rejected) by dictionaries of n-grams and plain sums, from a model's numbers."""
    import math
    if text is None:
        return "und", 0.0, True
    low = text.lower()
    words = "".join(c if c.isalpha() else " " for c in low).split()
    if not words:
        return "und", 0.0, True
    # a blank on either side, beside that of the text's own end
    padded = " " + " ".join(words) + " " * (1 if low[-1].isalpha() else 2)
    points = [ord(c) for c in padded]
    m32 = (1 << 32) - 1

    def place(h):
        return (h & m32) >> 18
    counts = collections.Counter(place(p * 0x9E3779B1) for p in points if p != 32)
    pairs = [(((a * 0x9E3779B1 & m32) ^ 0x85EBCA6B) * 0x9E3779B1 + b) & m32 for a, b in zip(points, points[1:])]
    counts.update(place(h * 0x9E3779B1) for h in pairs)
    counts.update(place(((h * 0xC2B2AE35 & m32) ^ (c * 0x9E3779B1 & m32)) * 0x9E3779B1) for h, c in zip(pairs, points[2:]))
    weights = {i: math.sqrt(n) * float(model["idf"][i]) for i, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    cosines = [sum(w * float(c[i]) for i, w in weights.items()) / norm for c in model["centroids"]]
    best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
    return model["langs"][best], cosines[best], 1 - cosines[best] > float(model["limits"][best])


def leaks_brute(texts, items, max_edits=0.07):
    """Whether each normalised text holds one of the normalised items with few enough edits: the
    whole dynamic programme, row by row, over all texts laid end to end."""
    line = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    ramp, found = np.arange(len(line) + 1, dtype=np.int32), np.zeros(len(texts), bool)
    for item in items:
        allowed = min(int(len(item) * max_edits), len(item) // 10 - 1) if len(item) >= 10 else 0
        row = np.zeros(len(line) + 1, np.int32)
        for c in item:
            new = np.empty_like(row)
            new[0] = row[0] + 1
            new[1:] = np.minimum(row[:-1] + (line != c), row[1:] + 1)
            row = np.minimum.accumulate(new - ramp) + ramp
        found[owner[np.flatnonzero(row[1:] <= allowed)]] = True
    return found
