import pytest

from voltaic.bindings import price_book
from voltaic.operators import materials, pricing, weights

# golden weights (jitter 1, three-phase) from the fixture table
GOLDEN = [
    (1000, 10.5, 0.4, 1281, 2672, 802, 1135, 1082, 6972),
    (4999, 20, 0.4, 3406, 7815, 2041, 2597, 2936, 18795),
    (5000, 20, 0.4, 2939, 6530, 1817, 2241, 2614, 16141),
    (10000, 33, 11, 4071, 8731, 2110, 2773, 3366, 21051),
    (50000, 110, 11, 9832, 22820, 5172, 5814, 8656, 52294),
    (51000, 110, 11, 6952, 14532, 3107, 3898, 5511, 34000),
    (60000, 110, 11, 8177, 17179, 3634, 4511, 6499, 40000),
    (90000, 115, 13.8, 11325, 23991, 4912, 5980, 9008, 55216),
    (200000, 230, 13.8, 15786, 34829, 6945, 7788, 13011, 78359),
    (250000, 400, 33, 17048, 37589, 7307, 8181, 13960, 84085),
]


def test_weight_golden_table(spark):
    rows = [(i, float(p), float(a), float(b), "Three-phase") for i, (p, a, b, *_) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "spec_id int, power_rating double, primary_voltage double, "
                                     "secondary_voltage double, phase string")
    out = {r["spec_id"]: r for r in weights.estimate_weights(df).collect()}
    for i, g in enumerate(GOLDEN):
        got = tuple(int(out[i][f"{c}_weight"]) for c in ["core", "copper", "insulation", "tank", "oil", "total"])
        assert got == g[3:], (g[0], got)


def test_components_sum_and_distribution(spark):
    df = spark.createDataFrame([(1, 1500.0, 11.0, 0.4, "Single-phase")],
                               "spec_id int, power_rating double, primary_voltage double, secondary_voltage double, "
                               "phase string")
    w = weights.estimate_weights(df)
    r = w.first()
    assert r["total_weight"] == sum(r[f"{c}_weight"] for c in ["core", "copper", "insulation", "tank", "oil"])
    dist = weights.weight_distribution(w).groupBy("spec_id").sum("percentage").first()[1]
    assert dist == pytest.approx(100.0)


def test_unknown_phase_rejected(spark):
    df = spark.createDataFrame([(1, 100.0, 11.0, 0.4, "two-phase"), (2, 100.0, 11.0, 0.4, None)],
                               "spec_id int, power_rating double, primary_voltage double, secondary_voltage double, "
                               "phase string")
    rows = {r["spec_id"]: r for r in weights.estimate_weights(df).collect()}
    assert rows[1]["core_weight"] is None
    assert rows[2]["core_weight"] is not None  # null phase -> three-phase


def test_rule_price_cases(spark):
    df = spark.createDataFrame([(1000.0, 33.0, 11.0, "ONAN", "Three-phase"), (400.0, 11.0, 0.433, "ONAF", "Single-phase")],
                               "power_rating_kva double, primary_voltage_kv double, secondary_voltage_kv double, "
                               "cooling_type string, phase string")
    got = [r[0] for r in pricing.rule_price(df).select("rule_price").collect()]
    assert got[0] == pytest.approx(30000.0)
    assert round(got[1], 2) == 12439.59


def test_cost_table_example(spark):
    spec = spark.createDataFrame([(1, 1200.0, 800.0, 200.0, 950.0, 1500.0, 4650.0)],
                                 "spec_id int, core_weight double, copper_weight double, insulation_weight double, "
                                 "tank_weight double, oil_weight double, total_weight double")
    t = {r["material"]: r for r in materials.cost_table(spec, price_book(spark)).collect()}
    assert t["Total Raw Materials"]["cost_usd"] == pytest.approx(14660.0)
    assert t["Total Raw Materials"]["weight_kg"] == 4650.0
    assert t["Copper"]["cost_usd"] == pytest.approx(7600.0)


def test_composition_adds_up(spark):
    df = spark.createDataFrame([(1, 100000.0, 60000.0, 8000.0), (2, 100000.0, 60000.0, 2000.0)],
                               "spec_id int, predicted_price double, material_cost double, power_rating double")
    for r in pricing.price_composition(df).collect():
        assert r["material_cost"] + r["lop_amount"] == pytest.approx(r["final_price"])
        assert r["lop_pct"] >= 30.0 or r["power_rating"] <= 5000


def test_fuzzy_material(spark):
    items = spark.createDataFrame([("copper_wire",), ("core plates",), ("coil",), ("bolts",), ("steel",)],
                                  "material string")
    got = {r["material"]: r["resolved_material"]
           for r in materials.resolve_materials(items, price_book(spark)).collect()}
    assert got == {"copper_wire": "copper", "core plates": "electrical_steel", "coil": "copper",
                   "bolts": "steel", "steel": "steel"}
