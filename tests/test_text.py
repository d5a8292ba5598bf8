from pyspark.sql import functions as F

from voltaic.functions import text as X


def one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_quantity_cases(spark):
    assert one(spark, X.parse_quantity, ["2 NOS", "284 UNT", None, "PAC", " 7"]) == [2, 284, 1, 1, 7]


def test_price(spark):
    assert one(spark, X.parse_price, ["$1,234.50", " $ 12 ", "n/a", None]) == [1234.5, 12.0, None, None]


def test_rating_patterns(spark):
    got = one(spark, X.rating_kva, ["500 KVA unit", "28/35MVA ONAN", "2.5 K.V.A", "10 mega volt ampere",
                                    "no rating", None])
    assert got == [500.0, 35000.0, 2.5, 10000.0, None, None]


def test_voltages_primary_not_rescaled(spark):
    df = spark.createDataFrame([("12075/651V",), ("33KV/433V",), ("11KV TO 400V",), ("none",)], "v string")
    got = [tuple(r[0]) for r in df.select(X.voltages("v")).collect()]
    assert got[0] == (12075.0, 0.651)
    assert got[1] == (33.0, 0.433)
    assert got[2] == (11.0, 0.4)
    assert got[3] == (None, None)


def test_equipment_substring_quirk(spark):
    got = one(spark, X.is_equipment, ["Oil Filled 500 KVA transformer", "Power transformer 40MVA",
                                      "LED lamp", None])
    assert got == [False, True, False, False]


def test_phase_type_frequency(spark):
    assert one(spark, X.phase_from_text, ["single phase unit", "3-phase", "power transformer", "x"]) == \
        ["Single-phase", "Three-phase", "Three-phase", None]
    assert one(spark, X.type_from_text, ["step down unit", "Dry type", "abc", ""]) == \
        ["Step-Down", "Dry-Type", "Power", None]
    assert one(spark, X.frequency_from_text, ["60 Hz", "for usage in USA", "Europe", None]) == \
        [60.0, 60.0, 50.0, None]


def test_destination_from_url(spark):
    assert one(spark, X.destination_from_url, [".../import/import-in-united-kingdom/", "https://x/other"]) == \
        ["United Kingdom", None]


def test_loose_rating_and_bad_number(spark):
    df = spark.createDataFrame([("1,000 kva unit",), ("2 mva",), ("1.2.3 kva",)], "v string")
    rows = df.select(X.rating_kva_loose("v"), X.rating_kva_loose_bad("v")).collect()
    assert [tuple(r) for r in rows] == [(1000.0, False), (2000.0, False), (None, True)]


#: Descriptions of public trade records with their rating (kVA) and voltages (kV).
KNOWN = [
    ("EQUIP. /DEVICE 2 X 600 TPD WTE TRANSFORMER 3.15MVA 11/0.433KV DISTRIBUTION TRANSFORMER", 3150.0, 11.0, 0.433),
    ("EQUIP. /DEVICE 2 X 600 TPD WTE TRANSFORMER 28/35MVA 11/132kV GENERATOR TRANSFORMER", 35000.0, 11.0, 132.0),
    ("ELECTRICAL TRANSFORMER 12000KVA 33KV/750 V X 4 OIL IMMERSED", 12000.0, 33.0, 0.75),
    ("33/11 KV, 10/13.33 MVA POWER TRANSFORMER TANK WITH OIL", 13330.0, 33.0, 11.0),
    ("220KV-132KV 75-105-150 MVA POWER TRANSFORMER", 150000.0, 220.0, 132.0),
    ("VOLTAGE RATING:12075/651V AC,CURRENT RATING:581 A,APPARENT POWER:12155 KVA", 12155.0, 12075.0, 0.651),
    ("POWER TRANSFORMER 50MVA 132/33 KV 3 PHASE AUTO TRANSFORMER", 50000.0, 132.0, 33.0),
    ("SINGLE-PHASE ELECTRIC TRANSFORMER WITH POWER 533000 KVA WITH LIQUID DIELECTRIC", 533000.0, None, None),
]


def test_known_ratings_and_voltages(spark):
    df = spark.createDataFrame([(i, k[0]) for i, k in enumerate(KNOWN)], "i int, d string")
    got = df.select("i", X.rating_kva("d").alias("kva"), X.voltages("d").alias("v")).orderBy("i").collect()
    assert [(r.kva, r.v.primary_kv if r.v else None, r.v.secondary_kv if r.v else None) for r in got] == [k[1:] for k in KNOWN]


def test_known_lot_prices(spark):
    from voltaic.operators import clean
    lots = spark.createDataFrame([("2", 64288.955), ("1", 329978.47), (None, 10.0), ("4 NOS", 100.0)], "quantity string, unit_price_usd double")
    got = clean.lot_to_unit_price(clean.clean_quantity(lots)).collect()
    assert [r["unit_price_usd"] for r in got] == [32144.4775, 329978.47, 10.0, 25.0]
