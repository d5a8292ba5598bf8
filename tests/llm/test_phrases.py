"""Phrase mining and its automata against plain counting."""

import collections
import random
import re

import numpy as np
import pytest
from helpers import EXTRA, empty_docs, odd_docs, odd_rows

from voltaic.llm import phrases
from voltaic.llm.automaton import Automaton, place, prefix_sums, sort_paths, union


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def phrases_brute(rows, min_count, percent, top):
    """Rows of ``collocations`` from (lang, text)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        longer = collections.Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        best = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if p not in longer or 100 * longer[p] < percent * a:
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def mixed_rows():
    rng = random.Random(3)
    words = ["a", "B", "b", "the", "x.y", "é", "zz", "\x00", "c\x1cd", "q", "中文"]
    rows = [(rng.choice(["en", None, "und", "fr"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", " ", "\n"]) for _ in range(rng.randint(0, 60))))
            for _ in range(120)]
    return rows + [("en", None), ("en", ""), (None, None), ("en", "hot pair " * 900), ("de", " . ,")]


@pytest.mark.parametrize("options", [{}, {"range_bytes": 300, "shard_words": 200, "slice_bytes": 50}, {"range_bytes": 2000, "max_ranges": 3, "shard_words": 3000}])
def test_op11_equals_plain_counting(spark, options):
    from pyspark.sql import functions as F
    rows = mixed_rows()
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    df = df.withColumns({c: F.lit(c) for c in EXTRA}).repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, min_count=4, top=50, **options).collect())
    assert got == phrases_brute(rows, 4, 80, 50)


def test_op11_odd_rows_and_empty_table(spark):
    rows = [(r[2], r[1]) for r in odd_rows()]
    got = sorted(tuple(r) for r in phrases.collocations(odd_docs(spark), min_count=3).collect())
    assert got == phrases_brute(rows, 3, 80, 2000)
    assert phrases.collocations(empty_docs(spark)).count() == 0


def test_slices_own_every_path_once():
    rng = random.Random(4)
    for _ in range(200):
        text = phrases._normal(["".join(rng.choice("ab  \n.") for _ in range(rng.randint(1, 80))).encode()])
        whole, cut = phrases._Shard(), phrases._Shard()
        whole.add(text)
        for part, own in phrases.slices(text, rng.randint(1, 20)):
            cut.add(part, own)
        if whole.size:
            a, b = whole.paths(), cut.paths()
            assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


@pytest.mark.parametrize("labels", [6, 70_000])
def test_automata_build_unite_compose_and_place(labels):
    rng = np.random.default_rng(labels)
    words = sorted({b"w%d" % i for i in range(labels)})
    raw = []
    for _ in range(3):
        p = rng.integers(1, 7, (400, 4)).astype(np.int32) if labels == 6 else (rng.integers(1, 4, (400, 4)) * 20_000).astype(np.int32)
        p[rng.random(400) < 0.3, 2:] = 0
        raw.append(p)
    parts = [Automaton.build(words, *sort_paths(p, labels)) for p in raw]
    count = collections.Counter(tuple(words[i - 1] for i in r if i) for p in raw for r in p.tolist())
    back = [Automaton.from_bytes(a.to_bytes()) for a in parts]
    united_words, paths, weight = union(back)
    assert {tuple(united_words[i - 1] for i in r if i): w for r, w in zip(paths.tolist(), weight.tolist())} == count
    ordered = [tuple(united_words[i - 1] if i else b"" for i in r) for r in paths.tolist()]
    assert ordered == sorted(ordered)
    whole = Automaton.build(united_words, paths, weight)
    asked = [*count, (b"none",), (united_words[0],) * 4, ordered[0][:1]]
    assert whole.weights_of(asked).tolist() == [count.get(a, 0) for a in asked]
    for bound in [*ordered[::7], (b"w3", b"zzz", b"", b""), (b"", b"", b"", b""), (b"zz", b"", b"", b"")]:
        assert place(united_words, paths, bound) == sum(p < bound for p in ordered)
    for size in (1, 2, 3, 4):
        at, sums = prefix_sums(paths, weight, size)
        assert sums.sum() == sum(c for p, c in count.items() if len(p) >= size)


def test_automata_share_equal_right_languages():
    paths = np.array([[a, b, 1, 0] for a in range(1, 11) for b in range(1, 11)], np.int32)
    a = Automaton.build([b"%02d" % i for i in range(1, 11)], paths, np.full(100, 7))
    assert [len(label) for _, label, _ in a.levels] == [10, 10, 1, 1]
    assert (a.paths()[0] == paths).all() and (a.paths()[1] == 7).all()
