"""A small local copy of the driver's correctness gate: Spark query vs DuckDB
oracle on the sf0.001 tables (the full set runs with scripts/oracle_check.py)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

SF = "/root/testdata/sf0.001"
NAMES = ["price_per_kva_by_origin", "weights_estimate", "cost_total_rows", "html_listings", "stats_histogram",
         "cost_price_priority", "dataset_specs", "model_ridge1"]


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    import duckdb
    import __spark_entry__ as E
    from oracle_check import digest
    from voltaic.bindings import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["union_distinct_rows", "clean_null_profile_table"])
def test_whole_tables_match_their_oracle(spark, name):
    test_query_matches_oracle(spark, name)


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_whole_tables_are_read(spark):
    import __spark_entry__ as E
    from voltaic.plans import dataset_queries, listing_queries
    profile = E.queries()["clean_null_profile_table"](spark, SF).collect()
    assert [r["column"] for r in profile] == listing_queries.cleaned(spark, SF).columns
    n = sum(r.n_distinct for r in E.queries()["union_distinct_rows"](spark, SF).collect())
    assert n == len({tuple(r) for r in dataset_queries.integrated(spark, SF).collect()}) > 100
