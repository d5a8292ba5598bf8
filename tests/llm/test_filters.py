import collections
import random
import re
from math import comb

import numpy as np
import pytest
from helpers import SF, edits_brute, empty_docs, odd_docs, odd_rows, sample_texts

from pyspark.sql import functions as F

from voltaic.llm import decontam, langid, licences, quality, queries, url_rules


# -- quality rules ---------------------------------------------------------------------------

def counts_brute(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), lines)


def test_op5_counts_equal_brute_force():
    for t in [t for _, t, _ in sample_texts()] + [r[1] for r in odd_rows()] + ["a b c a b c a b", "x\nx\n \n \nx"]:
        assert quality.text_counts(t) == counts_brute(t)


def test_op5_query(spark):
    texts = {i: t for i, t, _ in sample_texts()}
    rows = queries.op5_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = counts_brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest[:-1])
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n)
        assert r.kept == (not r.base_failed and r.rejected_by == "")


def test_op5_cutoffs_equal_a_plain_walk(spark):
    """Every cutoff that the query's operator certifies, against all its steps tried one after the other."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1500):
        lang, bad = ["en", "en", "de", None][i % 4], rng.random() < .15
        words = ["w" * rng.randint(2, 9) + str(rng.randint(0, 10**5)) for _ in range(rng.randint(55, 90))]
        words = [w + "#" * (rng.random() < (.4 if bad else .01)) for w in words]
        rows.append((i, " ".join(words), lang, "s", 1))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = quality.document_counts(docs, "lang")
    got = {(r.stratum, r.rule): (r.cutoff, r.n_good, r.n_rejected) for r in
           quality.certified_cutoffs(counts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), risk=0.05).collect()}
    good = {i for i, q, _ in labels if q}
    values = {}
    for r in counts.collect():
        if r.doc_id in good and not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words):
            for rule, v in (("symbols", r.n_symbols / max(r.word_chars, 1)), ("dup_lines", r.n_dup_lines / max(r.n_lines, 1)),
                            ("repeats", r.n_repeat_words / max(r.n_words, 1)), ("long_words", r.word_chars / max(r.n_words, 1))):
                values.setdefault((r.stratum, rule), []).append(v)
    assert len({s for s, _ in values}) == 3
    want = {}
    for key, v in values.items():
        v.sort()
        n, passed = len(v), None
        # few values: percentile_approx is exact, the least value whose rank is the step's share
        steps = sorted({v[max(0, -(-int(round((1 - 0.05 * j / 40) * n * 1e9)) // 10**9) - 1)] for j in range(41)}, reverse=True)
        for cutoff in steps:
            over = sum(x > cutoff for x in v)
            if sum(comb(n, i) * 0.05**i * 0.95**(n - i) for i in range(over + 1)) > quality.LEVEL / (4 * 3):
                break
            passed = (cutoff, n, over)
        if passed:
            want[key] = passed
    assert got == want and len(want) == 12


def test_op5_binomial_tail():
    for n, k, p in [(10, 0, .1), (30, 4, .2), (200, 3, .01), (1, 1, .5)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)), rel=1e-9)


def test_op5_certifies_only_what_the_labels_allow(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        stratum, bad = ("big" if i % 10 else "small"), rng.random() < .2
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 10**6)) for _ in range(60)]
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), stratum, "s", 1))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), risk=0.01).collect()
    bad = {i for i, q, _ in labels if not q}
    big = [r for r in got if r.stratum == "big"]
    assert all(r.kept for r in got if r.stratum == "small")                     # too few labels: nothing is certified
    assert sum(not r.kept for r in big if r.doc_id in bad) > 0.95 * sum(r.doc_id in bad for r in big)
    good = [r for r in big if r.doc_id not in bad]
    assert sum("symbols" in r.rejected_by for r in good) <= 0.01 * len(good)


def test_op5_every_good_label_certifies(spark):
    need = quality.labels_needed(2)
    assert quality.binomial_tail(0, need, quality.RISK) <= quality.LEVEL / 8 < quality.binomial_tail(0, need - 1, quality.RISK)
    assert quality.labels_needed(4) == 286
    words = " ".join(f"alpha{i}" for i in range(60))
    rows, labels = [], []
    for stratum, n in (("enough", need), ("short", need - 1)):
        for i in range(n + 40):
            rows.append((len(rows), words if i < n else words.replace(" ", "### "), stratum, "s", 1))
            labels.append((len(labels), int(i < n), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    bad = {i for i, q, _ in labels if not q}
    assert {r.doc_id for r in got if not r.kept} == {r.doc_id for r in got if r.stratum == "enough" and r.doc_id in bad}


def test_op5_cuts_a_rare_class_within_the_risk(spark):
    # 1 % of the good documents have the longest words; junk with words nearly as long is 1 % of all;
    # the others' ratios all differ by some, so a step of 5 % is no cutoff between them and the junk
    rows, labels = [], []
    for i in range(4000):
        size, good = (30 + i % 9, True) if i % 100 == 0 else (20, False) if i % 100 == 1 else (5, True)
        rows.append((i, " ".join(f"{j:0{size}}" for j in range(60)) + "x" * (i % 97), "en", "s", 1))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, lab).collect()}
    assert all(got[i].rejected_by == ["long_words"] for i, q, _ in labels if not q)
    assert 40 <= sum(not got[i].kept for i, q, _ in labels if q) <= 0.02 * 3960
    assert all(r.kept for r in quality.judge(docs, lab, risk=0.005).collect() if r.doc_id % 100 > 1)


def test_op5_odd_rows(spark):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = quality.judge(odd_docs(spark), lab).collect()
        assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == sorted((str(r[0]), counts_brute(r[1])[0], False) for r in odd_rows())
    assert quality.judge(empty_docs(spark), labels).count() == 0


# -- URL filters -----------------------------------------------------------------------------

def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = ["http://A.Example.com/en/1", "https://www.example.com/en/x", "x.example.com/en/", None, "", "http://net/es/", "http://a.net/es", "ftp://b.org?x=/en/#y",
        "http://example.com", "http://example.com?u=http://net/es/", "http://notexample.com/en/", "http://www.example.com/EN/", "://", "a://b://c/en/",
        "http://m.a.net/fr/1?q#z", "http://sub.www.example.com/en/9", "http://ex.org/en/\n/x"]


def test_op6_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in url_rules.judge(pages, labels, queries.URL_RULES).collect():
        host, path, rule, verdict = url_brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_op6_query(spark):
    import pandas as pd
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op6_url_rules(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, u in zip(pages.page_id, pages.url):
        host, path, rule, verdict = url_brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict)


def test_op6_mined_rules_equal_brute_force(spark):
    rng = random.Random(7)
    urls, labels = [], []
    for i in range(1500):
        words = [rng.choice(["news", "shop", "pills", "casino"]), rng.choice(["win", "daily", "free"])]
        urls.append((i, f"http://{words[0]}.site.org/{words[1]}/{i}"))
        bad = words in (["pills", "free"], ["casino", "win"]) or rng.random() < .02
        if i < 1000:
            labels.append((i, 1, int(bad)))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), queries.URL_RULES).collect()}
    toxic = {i for i, _, b in labels if b}
    items = {i: {"host:" + u.split("/")[2].split(".")[0], "host:site", "host:org", "path:" + u.split("/")[3]} for i, u in urls}
    sets = {frozenset(s) for i in range(1000) for n in range(1, 5) for s in __import__("itertools").combinations(sorted(items[i]), n)}
    rules = []
    for s in sets:
        having = [i for i in range(1000) if s <= items[i]]
        hits = sum(i in toxic for i in having)
        if hits >= 25 and hits / len(having) >= 0.6:
            rules.append(s)
    assert rules
    assert got == {i: "block" if any(r <= items[i] for r in rules) else "allow" for i, _ in urls}


def judged_by_brute_force(labelled, urls, min_count=25, min_confidence=0.6, max_tokens=3):
    """Verdict of each token set of ``urls`` by all rules over (token set, bad)."""
    from itertools import combinations
    hits, having = {}, {}
    for items, bad in labelled:
        for n in range(1, max_tokens + 1):
            for c in combinations(sorted(items), n):
                having[c] = having.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + bad
    rules = [set(c) for c, h in hits.items() if h >= min_count and h >= min_confidence * having[c]]
    return ["block" if any(r <= set(u) for r in rules) else "allow" for u in urls]


@pytest.mark.parametrize("label", [0, 1, 2])
def test_op6_long_urls_in_many_copies(spark, label):
    """1,000 copies of a URL of 40 words: all good, all bad, or alternating with a word that tells."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rng = random.Random(label)

    def url(i, drop=()):
        more = ["evil"] if label == 2 and i % 2 else []
        return "http://a.org/" + "/".join([w for w in words if w not in drop] + more) + f"?{i}=1"
    rows = [(i, url(i)) for i in range(1000)] + [(1000 + i, f"http://b.org/{rng.choice(words)}/{rng.choice(words)}") for i in range(200)]
    labels = [(i, 1, int(label == 1 or label == 2 and i % 2) if i < 1000 else 0) for i in range(1200)]
    probes = [(5000, url(5000)), (5001, "http://c.net/" + words[0]), (5002, "http://c.net/evil"), (5003, url(5003, words[:5]) + "&x=evil"), (5004, "http://a.org/")]
    pages = spark.createDataFrame(rows + probes, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()}

    def items(u):
        parts = u.split("://")[1].split("?")
        return ["host:" + x for x in parts[0].split("/")[0].split(".")] + ["path:" + x for x in parts[0].split("/")[1:] if x] + \
            ["query:" + x for x in parts[-1].split("&") if len(parts) > 1 and any(c.isalpha() for c in x)]
    # long URLs differ in no more than these items, so rules of two tokens tell all
    want = judged_by_brute_force([(items(u), b) for (_, u), (_, _, b) in zip(rows, labels)], [items(u) for _, u in probes], max_tokens=2)
    assert [got[i] for i, _ in probes] == want


@pytest.mark.parametrize("wide", [14, 2])
def test_op6_combinations_equal_brute_force(spark, wide, monkeypatch):
    monkeypatch.setattr(url_rules, "WIDE", wide)
    rng = random.Random(11)
    sets = [[f"host:{c}" for c in "abcdefg" if rng.random() < 0.6] for _ in range(500)]
    bad = [int({"host:a", "host:b", "host:c"} <= set(x) or {"host:d", "host:e"} <= set(x) and rng.random() < 0.9 or rng.random() < 0.05) for x in sets]
    labelled = spark.createDataFrame([(x, bool(b)) for x, b in zip(sets, bad)], "tokens array<string>, bad boolean")
    rules, members = url_rules.mine(labelled, min_count=20, min_confidence=0.8)
    urls = [[f"host:{c}" for c in "abcdefg" if rng.random() < 0.5] for _ in range(150)]
    hits = url_rules.blocked_by(spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], "url string, tokens array<string>"), rules, members)
    blocked = {int(r.url) for r in hits.collect()}
    want = judged_by_brute_force(list(zip(sets, bad)), urls, 20, 0.8)
    assert ["block" if i in blocked else "allow" for i in range(150)] == want and len(set(want)) == 2
    found = [set(r.rule) for r in rules.collect()]
    assert not any(a < b for a in found for b in found)


def test_op6_mines_words_of_any_script(spark):
    urls = [(i, f"http://site.org/{'новости' if i % 3 else '赌场'}/{i}?{'k' if i % 2 else 'к'}={i}") for i in range(300)]
    pages = spark.createDataFrame(urls + [(900, "http://пример.рф/赌场/900"), (901, "http://пример.рф/901")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages, labels, queries.URL_RULES).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(300) if i % 3 == 0} | {900}
    assert got[900].mined_rule == "path:赌场"


def test_op6_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, 1), (1, "http://a.org/x", 2), (1, "http://a.org/x", 2), (None, "http://a.org/x", 3)], "page_id long, url string, confidence int")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels, queries.URL_RULES, min_count=1).collect()
    assert len(got) == 4 and len({str(r) for r in got if r.page_id == 1}) == 1
    assert url_rules.judge(pages.limit(0), labels, queries.URL_RULES).count() == 0


# -- licences --------------------------------------------------------------------------------

def test_op2_repeated_rows_count_their_own_notices(spark):
    import duckdb
    notice = "Licensed under the MIT License."
    rows = [(1, f"a\n{notice}"), (1, f"a\n{notice}"), (1, f"a {notice}"), (None, notice), (None, notice), (None, None), (2, f"{notice}\n{notice}\nSPDX-License-Identifier: CC0-1.0"),
            (3, ""), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.digest or "", r.license_id or "", ",".join(r.notice_ids), r.n_notices) for r in licences.scan(docs).collect())
    con = duckdb.connect()
    con.execute("create table documents as select * from (values " + ", ".join(
        f"({'null' if i is None else i}, {'null' if t is None else 'replace(' + repr(t.replace(chr(10), '@')) + ', chr(64), chr(10))'})" for i, t in rows) + ") v(doc_id, text)")
    want = con.execute(licences.oracle()).fetchall()
    assert got == sorted((str(r[0]), r[1] or "", r[2] or "", r[3], r[4]) for r in want)
    assert sorted(r.n_notices for r in licences.scan(docs).collect()) == [0, 0, 0, 0, 1, 1, 1, 1, 3]
    assert licences.scan(docs, [], []).where("license_id is not null or n_notices > 0").count() == 0


@pytest.mark.skipif(not __import__("os").path.exists("/usr/share/common-licenses/MPL-2.0"), reason="no public licence texts here")
def test_op2_knows_whole_licences_in_other_layouts(spark):
    names = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]
    rows = []
    for i, (file, _) in enumerate(names):
        with open(f"/usr/share/common-licenses/{file}") as f:
            text = f.read()
        rows += [(3 * i, text), (3 * i + 1, "Copyright (c) 2020 Someone\n\n" + text.upper().replace("\n", "\r\n  "))]
        rows.append((3 * i + 2, text.replace(" you ", " they ").replace(" a ", " one ")))
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3 * i + j: name if j < 2 else None for i, (_, name) in enumerate(names) for j in range(3)}


def test_op2_finds_varied_spellings(spark):
    from voltaic.llm.licence_texts import ISC, MIT
    texts = ["Copyright (c) 2020 A. Person\n\n" + MIT.upper(), "© 1999 X\nAll rights reserved.\n" + MIT.replace(" ", "  ").replace('"', "“"),
             MIT.replace("MIT License", "MIT Licence"), ISC, MIT + " x", "text\n  released under the mit LICENCE!\nmore", None, "",
             "Copyright 2001 nobody", "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC-BY-NC 4.0\nThis work is licensed under the GNU General Public License, version 3."]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [got[i].license_id for i in range(10)] == ["MIT", "MIT", "MIT", "ISC"] + [None] * 6
    assert got[5].notice_ids == ["MIT"] and got[9].notice_ids == ["CC-BY-NC-4.0", "GPL-3.0"] and got[9].n_notices == 3
    assert got[6].digest is None and got[7].digest == got[8].digest


def test_op2_whole_texts_and_given_ones(spark):
    from voltaic.llm.licence_texts import BSD_2, BSD_3, KNOWN, UNLICENSE, UNLICENSE_WHOLE
    assert "\n\n3. Neither the name" in BSD_3 and BSD_3.endswith(BSD_2[-400:]) and UNLICENSE_WHOLE.count("\n\n") == 4
    own = "An own licence.\nDo what is right."
    docs = spark.createDataFrame(list(enumerate(["Copyright (c) 2011, X\n" + BSD_3, BSD_2, UNLICENSE, UNLICENSE_WHOLE.upper(), own])), "doc_id long, text string")
    want = ["BSD-3-Clause", "BSD-2-Clause", "Unlicense", "Unlicense"]
    assert [r.license_id for r in licences.scan(docs).orderBy("doc_id").collect()] == [*want, None]
    assert [r.license_id for r in licences.scan(docs, KNOWN + [("Own", own)]).orderBy("doc_id").collect()] == [*want, "Own"]


def test_op2_odd_rows(spark):
    got = licences.scan(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows()) and all(r.license_id is None and r.notice_ids == [] for r in got)
    assert licences.scan(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("name", ["op2_licences", "op7_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(df):
        return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_op2_plan_is_native(spark):
    plan = queries.op2_licences(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- decontamination -------------------------------------------------------------------------

def test_op9_equals_brute_force():
    rng = random.Random(2)
    texts = [decontam.normalise(t) for _, t, _ in sample_texts()][:60]
    items = [(j, t[50:50 + rng.randint(30, 120)]) for j, t in enumerate(texts[:8]) if len(t) > 200]
    index = decontam.Index(items, decontam.MAX_EDITS)
    docs = [b"", b"a", b"x" * 500]
    for _ in range(120):
        p = bytearray(rng.choice(index.items)[1])
        for _ in range(rng.randint(0, int(len(p) * .12))):
            q = rng.randrange(len(p))
            p[q:q + rng.randint(0, 1)] = rng.choice([b"", b"q", b"zz", b" "])
        host = rng.choice(texts)[:rng.randint(0, 250)]
        cut = rng.randint(0, len(host))
        docs.append(host[:cut] + bytes(p) + host[cut:])
    want = {}
    for d, text in enumerate(docs):
        for j, (_, item) in enumerate(index.items):
            e = edits_brute(item, text)
            if e <= index.edits[j]:
                want[d, j] = e
    assert {(d, j): e for d, j, e, _ in decontam.matches(docs, index)} == want
    assert len(want) > 40


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_op9_periodic_and_short_items_equal_brute_force(at_once, monkeypatch):
    monkeypatch.setattr(decontam, "POSTINGS_AT_ONCE", at_once)
    rng = random.Random(3)
    items = [(0, b"abc" * 20), (1, b"ab" * 25), (2, b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (3, b"abcab"), (4, b"x"), (5, b"one two three four five one two three four five one"), (6, b"")]
    index = decontam.Index(items, decontam.MAX_EDITS)
    docs = [b"", b"abc" * 100, b"ab" * 60, b"a" * 29, b"a" * 31, b"zabcabz", b"one two three four five " * 6]
    for _ in range(150):
        p = bytearray(rng.choice(items[:6])[1] * rng.randint(1, 3))
        for _ in range(rng.randint(0, 5)):
            q = rng.randrange(len(p) + 1)
            p[q:q + rng.randint(0, 1)] = rng.choice([b"", b"q", b"zz", b"a"])
        docs.append(b"q" * rng.randint(0, 20) + bytes(p) + b"r" * rng.randint(0, 9))
    allowed = [*index.edits.tolist(), 0, 0]
    want = {(d, j): e for d, text in enumerate(docs) for j, (_, item) in enumerate(index.items) if (e := edits_brute(item, text)) <= allowed[j]}
    assert [i for i, _ in index.items] == [0, 1, 2, 5, 3, 4]
    assert {(d, j): e for d, j, e, _ in decontam.matches(docs, index)} == want and len({j for _, j in want}) == 6


def test_op9_periodic_text_needs_bounded_memory():
    """1 MB of a text of period 10 against a 2 KB item of that period."""
    import subprocess
    import sys
    code = ("import resource, sys; sys.path.insert(0, '.'); from voltaic.llm import decontam; "
            "i = decontam.Index([(1, b'abcdefghi ' * 200), (2, b'abcdefghi ' * 199 + b'abcdefghij')], 0.07); "
            "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; "
            "m = decontam.matches([b'abcdefghi ' * 104858], i); "
            "print(sorted(x[:3] for x in m), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=__file__.rsplit("/tests/", 1)[0]).stdout
    found, mb = out.rsplit(" ", 1)
    assert found == "[(0, 0, 0), (0, 1, 1)]" and int(mb) < 500


def test_op9_query_holds_all_exact_passages(spark):
    import pandas as pd
    items = [(int(i), decontam.normalise(t)) for i, t in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    exact = {(i, j) for i, t, _ in sample_texts() for j, x in items if x in decontam.normalise(t)}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op9_decontamination(spark, SF).collect()}
    assert exact == {k for k, e in got.items() if e == 0} and exact


def test_op9_odd_rows_and_blocks(spark):
    item = "The quick brown fox, it jumps over the lazy dog; twice."
    bench = spark.createDataFrame([(1, item), (2, item), (None, "a wholly different item that is long enough"), (3, None), (4, ""), (5, "short"), (6, " -;")], "item_id long, text string")
    docs = odd_docs(spark).unionByName(spark.createDataFrame(
        [(50, "x " + item.upper().replace(",", " - ") + " y", "en", "s", 1), (None, item.replace("quick", "quikc"), "en", "s", 1), (51, item[:30], "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    one = sorted(str(tuple(r)) for r in decontam.contaminated(docs, bench).collect())
    assert one == sorted(str(tuple(r)) for r in decontam.contaminated(docs, bench, block_bytes=60).collect())
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [("50", 1), ("50", 2), ("None", 1), ("None", 2)]
    clean = decontam.uncontaminated(docs, bench, block_bytes=60)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert decontam.contaminated(empty_docs(spark), bench).count() == 0
    assert decontam.uncontaminated(docs, bench.limit(0)).count() == docs.count()


# -- language --------------------------------------------------------------------------------

def test_op10_held_out_accuracy(spark):
    import zlib
    truth = {i: lang for i, _, lang in sample_texts()}
    rows = queries.op10_langid(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_op10_equals_brute_force(spark):
    from helpers import langid_brute
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.training_docs(docs))
    texts = {i: t for i, t, _ in sample_texts() if len(t) < 6000}
    extra = ["Ünïcödé straße 中文 word", "a", "x1y2 z", "İstanbul'da güzel", "", "12 34", None]
    want = {i: langid_brute(t, model) for i, t in texts.items()}
    rows = queries.op10_langid(spark, SF).where(F.col("doc_id").isin(list(texts))).collect()
    assert len(rows) == len(texts) > 100
    for r in rows:
        lang, score, rejected = want[r.doc_id]
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - score) < 1e-4
    for t, (lang, score, rejected) in zip(extra, langid.predict(extra, model, langid.MAX_DISTANCE)):
        want_lang, want_score, _ = langid_brute(t, model)
        assert lang == want_lang and abs(score - max(0.0, want_score)) < 1e-4


def test_op10_fit_is_that_of_dense_vectors():
    texts, langs = [t for _, t, _ in sample_texts()][:60], [lang for *_, lang in sample_texts()][:60]
    model = langid.fit(texts + [None, "1"], langs + ["en", "fr"])
    counts = np.stack([langid.ngram_counts(t) for t in texts])
    idf = np.log(61 / (1 + (counts > 0).sum(0))) + 1
    assert np.allclose(model["idf"], idf, rtol=1e-6) and sorted(set(model["langs"])) == sorted(set(langs))
    assert np.allclose(np.linalg.norm(model["centroids"], axis=1), 1, atol=1e-5)


def test_op10_odd_rows(spark):
    model = langid.fit([t for _, t, _ in sample_texts()], [lang for *_, lang in sample_texts()])
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(70, "123 ... 45", "en", "s", 1), (71, "你好 世界 再見", "en", "s", 1)],
                                                             "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 4, 70)] == ["und"] * 4 and all(got[i].rejected for i in (1, 2, 4, 70, 71))
    assert got[7].lang_pred in model["langs"] and got[8].score == got[7].score
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {70, 71}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(empty_docs(spark), model).count() == 0
    assert langid.train(empty_docs(spark))["langs"] == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty_docs(spark))).collect()} == {"und"}


def test_op10_rejects_what_no_centroid_is_near(spark):
    import base64
    rng = random.Random(3)
    model = langid.train(langid.training_docs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))  # enough texts of each language
    strange = {
        "letters": " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(200)),
        "base64": base64.b64encode(rng.randbytes(3000)).decode(),
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
              "i powinni postępować wobec innych w duchu braterstwa.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
              "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı "
              "kardeşlik zihniyeti ile hareket etmelidirler.",
    }
    found = dict(zip(strange, langid.predict(list(strange.values()), model, langid.MAX_DISTANCE)))
    assert all(rejected for _, _, rejected in found.values()), found
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(strange.values())] + [(9, sample_texts()[0][1])], "doc_id long, text string")
    assert [r.doc_id for r in langid.accepted(docs, model).collect()] == [9]
    assert [r.doc_id for r in langid.identify(docs, model).collect() if not r.rejected] == [9]


def test_op10_limits_of_few_texts():
    texts = [t for _, t, lang in sample_texts() if lang == "en"]
    assert langid.fit(texts[:5], ["en"] * 5)["limits"].tolist() == [langid.MAX_DISTANCE] * langid.CENTROIDS_PER_LANG
    assert langid.fit([], [])["limits"].tolist() == []
    model = langid.fit(texts[:60] + ["hola"], ["en"] * 60 + ["es"])  # a language of one text is judged by all texts
    assert model["langs"].count("es") == 1 and len(model["limits"]) == len(model["langs"]) and 0.5 < model["limits"].min() <= model["limits"].max() < langid.MAX_DISTANCE


def test_op10_sample_is_bounded_and_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {t for _, t, _ in sample_texts()}
    rows = langid.training_sample(docs, per_lang=7).collect()
    per = collections.Counter(r.lang for r in rows)
    assert set(per.values()) == {7} and all(r.text in texts for r in rows)


def test_op10_sample_is_of_different_texts(spark):
    rows = [("en", f"text number {i}") for i in range(40)] + [("fr", f"texte {i % 10}") for i in range(20_000)]
    labelled = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = [(r.lang, r.text) for r in langid.training_sample(labelled, per_lang=15).collect()]
    assert len(got) == len(set(got)) and collections.Counter(lang for lang, _ in got) == {"en": 15, "fr": 10}
    assert langid.training_sample(labelled.limit(0)).columns == ["text", "lang"]
