import hashlib
import random

import numpy as np
import pytest
from helpers import (SF, components_brute, empty_docs, lines_brute, odd_docs, odd_rows, removed_brute, sample_texts, simhash_brute)

from voltaic.llm import line_dedup, queries, simhash, suffix_dedup


def simhash_expected(rows):
    fps = [simhash_brute(t) for _, t in rows]
    roots = components_brute(fps, 4)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots)]


def test_op3_equals_brute_force(spark):
    rows = [(i, t) for i, t, _ in sample_texts()]
    got = [tuple(r) for r in queries.op3_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(simhash_expected(rows))


def test_op3_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, simhash_expected(rows)))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.representatives(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in simhash_expected(rows)})


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5])
def test_op3_links_lose_nothing(spark, bits):
    rng = random.Random(bits)
    fps = set()
    for _ in range(12):  # chains whose ends are far apart, and strays
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(0, 6)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    from voltaic.llm.common import connected_components
    rooted = dict(connected_components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long"), "test").collect()) if links else {}
    want = components_brute(fps, bits)
    pairs = list(zip([rooted.get(s, s) for s in signed], want))
    assert len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= bits for r in links)


def test_op4_equals_brute_force(spark):
    rows = sample_texts()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_suffix_dedup(spark, SF).collect()}
    assert got == dict(zip([i for i, *_ in rows], removed_brute([t for _, t, _ in rows])))


@pytest.mark.parametrize("max_distinct", [1, 5, 50_000])
def test_op4_odd_rows_with_and_without_hot_anchors(spark, max_distinct):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))
    rows = odd_rows() + [(100 + j, "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 60):] + "ü" * j, "en", "s", 1) for j in range(30)]
    rows = [r for r in rows if r[0] != 5] + [(5, "x" * 900, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = suffix_dedup.remove_repeats(docs, max_distinct=max_distinct).collect()
    have = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    want = sorted((str(r[0]), *b) for r, b in zip(rows, removed_brute([r[1] for r in rows])))
    assert have == want
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0
    assert suffix_dedup.remove_repeats(odd_docs(spark)).columns == ["doc_id", "kept", "n_bytes", "n_removed", "spans"]


def test_op4_hot_anchor_is_split_into_small_groups(spark, monkeypatch):
    """1,500 documents embed one passage between texts of their own, some of them alike near it."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(215))
    sides = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60))) + rng.choice(sides) + passage[rng.randint(0, 9):] + rng.choice(sides)
             + "".join(rng.choice("uvw ") for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(docs, max_distinct=100).collect()}
    assert got == dict(zip([i for i, _ in rows], removed_brute([t for _, t in rows])))
    # the pieces that a hot anchor is cut into: equal strings share a group
    seen: dict[bytes, set] = {}
    for width in suffix_dedup.WIDTHS:
        pieces = [t.encode()[a:a + n] for t in [rows[0][1], rows[1][1]] for _, _, _, a, n in zip(*suffix_dedup.segments([t.encode()]))]
        batch = __import__("pyarrow").RecordBatch.from_pydict({"k1": [1] * len(pieces), "k2": [1] * len(pieces), "base": [0] * len(pieces), "h": [7] * len(pieces),
                                                               "copies": [1] * len(pieces), "text": pieces})
        seen.clear()
        strings = 0
        for out in suffix_dedup._split(width, 200)(iter([batch])):
            for r in out.to_pylist():
                strings += r["size"] - 199
                assert r["size"] - 199 <= width
        assert strings == sum(len(p) - 199 for p in pieces)


def test_op4_merge_of_shards_is_independent_of_shards():
    rng = random.Random(4)
    common = [bytes(rng.choice(b"ab") for _ in range(300)) for _ in range(3)]
    pieces = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 99))) + rng.choice(common) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 99)))
                   for _ in range(60)})
    runs = []
    for shard in (400, 5000, 1 << 20):
        piece, place, block, prefix = suffix_dedup.merged_classes(pieces, shard_bytes=shard)
        strings = [(pieces[p] * 3)[o:o + 200] for p, o in zip(piece.tolist(), place.tolist())]
        by_class = {}
        for s, b, first, second in zip(strings, block.tolist(), prefix.tolist(), [None, *strings[:-1]]):
            assert by_class.setdefault(b, s) == s
            if second is not None:  # common prefix with the row above, in whole symbols
                same = next((i for i in range(25) if s[8 * i:8 * i + 8] != second[8 * i:8 * i + 8]), 25)
                assert first == same
        assert len(set(by_class.values())) == len(by_class)
        runs.append(sorted(by_class.values()))
    assert runs[0] == runs[1] == runs[2]


def test_op4_long_text_in_parts():
    rng = random.Random(5)
    old = suffix_dedup.CHUNK_BYTES
    text = bytes(rng.choice(b"abcdefghijkl") for _ in range(30_000))
    try:
        suffix_dedup.CHUNK_BYTES = 1000
        starts = [int(s) + k for _, _, _, start, size in suffix_dedup._long_segments(text, 200) for s, n in zip(start, size) for k in range(int(n) - 199)]
    finally:
        suffix_dedup.CHUNK_BYTES = old
    assert sorted(starts) == list(range(30_000 - 199))
    assert np.array_equal(suffix_dedup.sliding_min(np.array([5, 3, 4, 1, 9, 2], np.uint64), 3), [3, 1, 1, 1])


def line_rows(spark, docs):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(docs).collect())


def expected_lines(rows):
    return sorted((str(i), n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, d, t) in zip(rows, lines_brute(rows)))


def test_op7_equals_brute_force(spark):
    rows = [(i, t) for i, t, _ in sample_texts()]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op7_line_dedup(spark, SF).collect())
    assert got == expected_lines(rows)


def test_op7_odd_rows(spark):
    assert line_rows(spark, odd_docs(spark)) == expected_lines([(r[0], r[1]) for r in odd_rows()])
    assert line_dedup.line_digests(empty_docs(spark)).count() == 0
    kept = line_dedup.deduplicate_lines(odd_docs(spark))
    assert kept.columns == [*odd_docs(spark).columns, "_lines"]


def test_op7_documents_of_many_dropped_lines(spark):
    """Six documents of 40,000 shared lines, one of them twice, and two rows without an id."""
    import time
    lines = [f"{i:06d} a line of more than forty characters in all documents" for i in range(40_000)]
    rows = [(i, "\n".join(lines + [f"own {i}"])) for i in range(6)] + [(2, "\n".join(lines + ["own 2"])), (None, lines[7] + "\nx"), (None, "y\n" + lines[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    begin = time.time()
    got = {(r.doc_id, r.text[:5]): (r.text, r._lines.n_lines, r._lines.n_dropped) for r in line_dedup.deduplicate_lines(docs).collect()}
    assert time.time() - begin < 60
    assert {k: v for k, v in got.items() if k[0] != 5} == {**{(i, f"own {i}"): (f"own {i}", 40_001, 40_000) for i in range(5)},
                                                          (None, "x"): ("x", 2, 1), (None, "y"): ("y", 2, 1)}
    assert [v for k, v in got.items() if k[0] == 5] == [("\n".join(lines + ["own 5"]), 40_001, 0)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_op7_runs_compact_and_anti_join(spark, batches, fanout):
    from voltaic.session import scratch_path
    store = line_dedup.LineRuns(spark, scratch_path(spark, f"runs-{batches}-{fanout}"), fanout)
    rng, seen, counts = random.Random(batches), set(), {}
    for b in range(batches):
        keys = {(rng.randint(0, 30), 0, 1000 - 10 * b - d) for d in range(10) for _ in range(3)}
        df = spark.createDataFrame(list(keys), "k1 long, k2 long, doc_id long")
        new = {r.k1 for r in store.unseen(df).collect()}
        assert new == {k for k, *_ in keys} - seen
        seen |= new
        store.add(df)
        for k, _, d in keys:
            n, last = counts.get(k, (0, -1))
            counts[k] = (n + 1, max(last, d))
        assert all(len(level) < fanout for level in store.levels)
    assert {r.k1: (r.n_docs, r.last_doc) for r in store.state().collect()} == counts
