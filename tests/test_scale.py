"""Plans and numbers of tasks that decide how a query grows."""

import re

from pyspark.sql import DataFrameWriter

from voltaic import bindings as B

SF = "/root/testdata/sf0.001"


def test_listing_rows_are_shuffled_without_their_texts(spark):
    text = B.render(B.SPARK_LISTINGS, "spark", SF).replace("REPARTITION(files,", "REPARTITION(16,")
    found, asked = spark.sql(text), spark.sql(B.render(B.LISTINGS, "spark", SF))
    assert found.columns == asked.columns and found.count() == asked.count() > 0
    assert found.exceptAll(asked).isEmpty() and asked.exceptAll(found).isEmpty()
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\) (?:Exchange|BroadcastExchange)\b.*\nInput \[\d+\]: \[(.*)\]", plan)
    rows = [e for e in exchanges if "l_orderkey" in e]
    assert rows and not any(name in e for e in rows for name in ("p_name", "p_type", "description"))


def test_values_are_not_broadcast_to_their_groups_statistics(spark):
    from voltaic.operators import stats
    df = spark.range(20000).selectExpr("id % 2 as g", "cast(id * id % 9973 as double) as v")
    for made in (stats.histogram(df, "v", ["g"]), stats.box_stats(df, "v", ["g"])):
        assert made.count() > 1
        plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = re.findall(r"\) BroadcastExchange\b.*\nInput \[\d+\]: \[(.*)\]", plan)
        assert sent and not any(re.search(r"\b(?:__v|v)#", names) for names in sent)


def test_generated_rows_are_spread_over_tasks(spark, tmpdir_path):
    from voltaic.plans import dataset_queries as DQ
    spark.range(100_000).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmpdir_path}/part.parquet")
    made = DQ.gen_specs(spark, tmpdir_path)
    assert made.rdd.getNumPartitions() == 5 and made.count() == 100_000


def test_listings_are_joined_without_sorting_line_items(spark, tmpdir_path, monkeypatch):
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(500).write.parquet(f"{tmpdir_path}/{t}.parquet")
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: written.append(spark.conf.get(B.HASH_JOIN)) or write(self, *a, **k))
    limit, was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(B.HASH_JOIN)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert B.listings(spark, tmpdir_path).count() >= 0 and written == [B.HASHED] and spark.conf.get(B.HASH_JOIN) == was
        with B.hashed_joins(spark):
            rows = spark.sql(B.render(B.SPARK_LISTINGS, "spark", SF).replace("REPARTITION(files,", "REPARTITION(16,"))
            assert len(rows.collect()) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
