import hashlib

import corpus_pipeline as pipeline
from helpers import SF, components_brute, empty_docs, langid_brute, leaks_brute, lines_brute, odd_docs, sample_texts, simhash_brute

from voltaic.llm import langid


def test_run_equals_the_stages_by_brute_force(spark):
    import pandas as pd
    rows = [(i, t) for i, t, _ in sample_texts()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.training_docs(docs))
    rows = [(i, t) for i, t in rows if not langid_brute(t, model)[2]]
    rows = [(i, t) for (i, _), (_, _, t) in zip(rows, lines_brute(rows))]
    roots = components_brute([simhash_brute(t) for _, t in rows], 4)
    first = {}
    for (i, t), r in zip(rows, roots):
        first.setdefault(r, (i, t))
    def plain(t):
        return " ".join("".join(c if ord(c) > 127 or c.isalnum() else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)).split(" ")).encode()

    def normal(t):
        return b" ".join(x for x in plain(t).split(b" ") if x)
    items = [normal(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    leaks = leaks_brute([normal(t) for _, t in first.values()], items)
    rows = [r for r, leak in zip(first.values(), leaks) if not leak]
    assert 0 < leaks.sum() < len(leaks) / 2
    got = pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert all(r.n_tokens * 4 == len(r.ids) for r in got) and len(got) > 50


def test_stages_keep_columns_and_take_odd_rows(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontaminate", "encode"]
    docs = odd_docs(spark)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        stage(spark, docs, SF).collect()
        assert stage(spark, empty_docs(spark), SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
