"""Language identification by nearest centroid.

A text is a vector of character n-gram counts (1 to 3 letters, words padded by a blank,
hashed to ``DIMS`` places), damped and weighted by inverse document frequency and
normalised.  Several centroids per language come from clustering the vectors of a bounded
sample of labelled texts (spherical k-means).  The nearest centroid by cosine gives the
language; a text further from it than that centroid's limit is rejected.  The limit comes
from the training texts: the cosine that all but ``LIMIT_QUANTILE`` of the centroid's own
texts reach, each taken out of its centroid first, times ``LIMIT_MARGIN``.  A centroid of
fewer than ``LIMIT_TEXTS`` texts takes the limit of all its language's texts, a language
of fewer that of all texts, and with fewer texts at all ``MAX_DISTANCE`` is the limit.

Results for odd input: a null text, or one without a letter, is ``und`` with score 0 and
rejected; equal texts get equal results; ties go to the alphabetically first language; a
null ``doc_id`` passes through; an empty table gives no rows, and without any labelled
text every text is ``und``; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_slices, worker_state

#: Places of the hashed n-gram vector.
DIMS = 1 << 14
#: Bound of the sample the model is fitted on: texts per language, and their longest (whole) text.
SAMPLE_PER_LANG = 300
SAMPLE_CHARS = 20_000
CENTROIDS_PER_LANG = 4
#: Cosine distance beyond which a text is rejected, whatever its centroid's own limit.
MAX_DISTANCE = 0.9
#: Share of a centroid's texts that may lie beyond its limit before the margin, the margin (a short
#: text has fewer n-grams than the texts learned from, so a lower cosine), and the least texts for a limit.
LIMIT_QUANTILE = 0.01
LIMIT_MARGIN = 0.45
LIMIT_TEXTS = 20
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    is_letter = _letter_table()[np.minimum(points, 0x2FFFF)]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, points, 32)[keep]
    return np.concatenate([np.array([32], out.dtype), out, np.array([32], out.dtype)])


def _letter_table() -> np.ndarray:
    return worker_state("langid:letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000))


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts, or None for a text without a letter."""
    if not text:
        return None
    p = letters(text).astype(np.uint32)
    if len(p) <= 2 and not (p != 32).any():
        return None
    mix = np.uint32(0x9E3779B1)
    one = p * mix
    two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * mix + p[1:]
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (p[2:] * mix)
    shift = np.uint32(32 - (DIMS - 1).bit_length())
    places = np.concatenate([one[p != 32], two * mix, three * mix]) >> shift
    return np.bincount(places, minlength=DIMS).astype(np.float32)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    return v / (np.linalg.norm(v) or 1.0)


def fit(texts: list[str], langs: list[str], centroids_per_lang: int = CENTROIDS_PER_LANG, rounds: int = 8) -> dict:
    """The model of a bounded sample, fitted on the driver: beside ``CENTROIDS_PER_LANG`` x ``DIMS`` floats
    (256 KB) and the distinct n-grams of ``SAMPLE_PER_LANG`` texts (about 5 MB) for each language it
    holds one language's vectors (20 MB), so 100 languages take about 550 MB.  ``idf``, ``centroids`` (rows), their ``langs`` and ``limits`` (cosine distances)."""
    # counts are held sparse; one language's vectors at a time are dense
    sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    df, n = np.zeros(DIMS, np.int64), 0
    for text, lang in zip(texts, langs):
        c = ngram_counts(text)
        if c is not None:
            at = np.flatnonzero(c).astype(np.uint16)
            sparse.setdefault(lang, []).append((at, c[at]))
            df[at] += 1
            n += 1
    if not n:
        return {"idf": np.zeros(DIMS, np.float32), "centroids": np.zeros((0, DIMS), np.float32), "langs": [], "limits": np.zeros(0)}
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def dense(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        c = np.zeros(DIMS, np.float32)
        c[at] = values
        return vector(c, idf)
    rows, names, reached = [], [], []
    for lang in sorted(sparse):
        own = np.stack([dense(*c) for c in sparse.pop(lang)])
        centres = own[[0]]
        while len(centres) < min(centroids_per_lang, len(own)):  # the text furthest from all centres so far
            centres = np.vstack([centres, own[np.argmin((own @ centres.T).max(axis=1))]])
        for _ in range(rounds):
            nearest = (own @ centres.T).argmax(axis=1)
            centres = np.stack([own[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        rows.append(centres)
        names += [lang] * len(centres)
        reached.append(own_cosines(own, centres))
    return {"idf": idf, "centroids": np.vstack(rows).astype(np.float32), "langs": names, "limits": distance_limits(reached)}


def own_cosines(own: np.ndarray, centres: np.ndarray) -> list[np.ndarray]:
    """For each centre, the cosines of its texts to the nearest centre of their language when
    they are not part of it themselves."""
    cosines = own @ centres.T
    nearest = cosines.argmax(axis=1)
    for j in range(len(centres)):
        at = np.flatnonzero(nearest == j)
        others = own[at].sum(axis=0) - own[at]
        cosines[at, j] = (own[at] * others).sum(axis=1) / np.maximum(np.linalg.norm(others, axis=1), 1e-12)
    best = cosines.max(axis=1)
    return [best[nearest == j] for j in range(len(centres))]


def distance_limits(reached: list[list[np.ndarray]]) -> np.ndarray:
    """The rejection distance of each centroid from ``own_cosines`` of each language."""
    limits = []
    everything = np.concatenate([c for of_lang in reached for c in of_lang])
    for of_lang in reached:
        for own in of_lang:
            enough = next((c for c in (own, np.concatenate(of_lang), everything) if len(c) >= LIMIT_TEXTS), None)
            limits.append(MAX_DISTANCE if enough is None else 1 - LIMIT_MARGIN * np.quantile(enough, LIMIT_QUANTILE))
    return np.minimum(limits, MAX_DISTANCE)


def training_sample(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``per_lang`` different whole texts of each language (``text``, ``lang``), chosen by a hash of
    the text among those of at most ``max_chars`` characters."""
    rows = (labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .where("text is not null and lang is not null").where(F.char_length("text") <= max_chars))
    # a share of each language's different texts by hash, twice as many as needed, so that few texts move; their
    # number is a sketch's, within a few percent; one per language goes to the driver, where the model keeps centroids for each
    rows = rows.withColumn("h", F.xxhash64("text"))
    share = {r["lang"]: min(1.0, (2 * per_lang + 200) / max(1, r["n"]))
             for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not share:
        return rows.select("text", "lang")
    limits = F.create_map(*[F.lit(x) for lang, p in share.items() for x in (lang, int(p * (1 << 40)))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 40)) < limits[F.col("lang")])
    once = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies are combined where they lie
    first = Window.partitionBy("lang").orderBy("h")
    return once.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).select("text", "lang")


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict:
    sample = training_sample(labelled, per_lang).orderBy("lang", "text").collect()
    return fit([r.text for r in sample], [r.lang for r in sample])


def predict(texts: list[str | None], model: dict, max_distance: float) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    out = []
    for text in texts:
        counts = ngram_counts(text)
        if counts is None or not model["langs"]:
            out.append((UNKNOWN, 0.0, True))
            continue
        cosines = model["centroids"] @ vector(counts, model["idf"])
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        out.append((model["langs"][best], score, 1 - score > min(max_distance, float(model["limits"][best]))))
    return out


def identify(docs: DataFrame, model: dict, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS_PER_LANG x DIMS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            rows = predict(batch.column(1).to_pylist(), shared.value, max_distance)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean"))


def accepted(docs: DataFrame, model: dict, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            rows = predict(batch.column(at).to_pylist(), shared.value, max_distance)
            yield batch.filter(pa.array([not r[2] for r in rows], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(5)) == 0


def training_docs(docs: DataFrame) -> DataFrame:
    """Documents a model may learn from: not held out, language known."""
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
