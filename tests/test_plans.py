"""Plan-shape checks: the properties the scale design relies on."""

from pyspark.sql import functions as F

from voltaic.operators import clean, materials
from voltaic.bindings import price_book


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parse_runs_once_per_row(spark):
    df = spark.createDataFrame([("500 KVA transformer", "$ 10", "2 NOS", "X")],
                               "description string, unit_price string, quantity string, origin string")
    out = clean.clean_listings(df).select("origin", "unit_price_usd")
    plan = _plan(out)
    # the KVA pattern is evaluated inside the generator only, not again in the filters
    assert plan.count("[\\s-]*KVA") == 1
    assert "Generate inline" in plan


def test_cost_table_has_no_shuffle(spark):
    spec = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, 5.0, 15.0)],
                                 "spec_id int, core_weight double, copper_weight double, insulation_weight double, "
                                 "tank_weight double, oil_weight double, total_weight double")
    plan = _plan(materials.cost_table(spec, price_book(spark)))
    assert "Exchange hashpartitioning" not in plan or "spec_id" not in plan.split("Exchange hashpartitioning")[1][:80]
    assert "BroadcastExchange" in plan or "Broadcast" in plan


def test_feed_merge_is_an_aggregate(spark):
    q = spark.createDataFrame([(1, "copper", "web", 1.0, "USD/Ton", "2024-01-01"),
                               (2, "copper", "api", 2.0, "USD/Ton", "2023-01-01"),
                               (3, "copper", "api", 3.0, "USD/Ton", "2024-01-01")],
                              "quote_id int, material string, feed string, price double, unit string, d string")
    q = q.withColumn("price_date", F.to_date("d")).drop("d")
    out = materials.merge_price_feeds(q)
    assert "Window" not in _plan(out)
    assert out.first()["price"] == 3.0
