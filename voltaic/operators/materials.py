"""Raw-material pricing: price book I/O (S5, S6), component x material join (J2),
fuzzy material resolution (J3), feed priority merge (J5), per-spec cost table
with a total row (A10 / Q6), staleness (Q10) and metric lookup with defaults (J6).

The price book is a dimension: one row per material.  How it is joined is left to the
optimizer, which broadcasts it by its measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .pricing import lookup

BOOK_SCHEMA = "map<string, struct<price: double, unit: string, date: string>>"
COMPONENT_MATERIAL = [(c[0], c[7]) for c in K.COMPONENTS]
TOTAL_LABEL = "Total Raw Materials"


# --- S5 / S6: JSON price book -------------------------------------------------------

def read_price_book(spark: SparkSession, path: str) -> DataFrame:
    """``{material: {price, unit, date}}`` -> rows (material, price, unit,
    price_date, book_order).  The book is one JSON object (a small file)."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", BOOK_SCHEMA).alias("m"))
    return (m.select(F.posexplode(F.map_entries("m")).alias("book_order", "e"))
             .select(F.col("e.key").alias("material"), F.col("e.value.price").alias("price"),
                     F.col("e.value.unit").alias("unit"),
                     F.to_date(F.col("e.value.date")).alias("price_date"), "book_order"))


def write_price_book(book: DataFrame, path: str) -> None:
    """Back to one JSON object in book order (overwrite).  A book is one object, so its
    entries (one per material) meet in one row."""
    entries = F.sort_array(F.collect_list(F.struct("book_order", "material", F.struct(
        "price", "unit", F.date_format("price_date", "yyyy-MM-dd").alias("date")).alias("v"))))
    obj = book.agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["material"], e["v"])))
                   .alias("m"))
    obj.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


# --- J2: component costs ---------------------------------------------------------------

def component_rows(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """Five weight columns -> (key, component, material, component_order, weight_kg)."""
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(m).alias("material"),
                              F.lit(i).alias("component_order"),
                              F.col(f"{c}_weight").cast("double").alias("weight_kg"))
                     for i, (c, m) in enumerate(COMPONENT_MATERIAL)])
    return specs.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def component_costs(specs: DataFrame, book: DataFrame, key: str = "spec_id") -> DataFrame:
    """cost = kg / 1000 x price per ton, one row per spec and component."""
    b = book.select("material", "price", "price_date")
    return (component_rows(specs, key).join(b, "material", "left")
            .withColumn("cost_usd", F.col("weight_kg") / 1000.0 * F.col("price")))


def _book_row(book: DataFrame) -> DataFrame:
    """The five priced materials as one row (price and date per component): a
    bounded, size-checked pivot of the price-book dimension."""
    b = book.where(F.col("material").isin(*[m for _, m in COMPONENT_MATERIAL]))
    aggs = []
    for c, m in COMPONENT_MATERIAL:
        aggs.append(F.max(F.when(F.col("material") == m, F.col("price"))).alias(f"__p_{c}"))
        aggs.append(F.max(F.when(F.col("material") == m, F.col("price_date"))).alias(f"__d_{c}"))
    return b.agg(*aggs)


def spec_costs_wide(specs: DataFrame, book: DataFrame) -> DataFrame:
    """Per spec, in its own row: ``<component>_cost`` for the five components and
    ``material_cost`` (their sum).  One broadcast of a one-row price pivot; no
    shuffle of the spec table."""
    row = F.broadcast(_book_row(book))
    out = specs.crossJoin(row)  # one row of prices
    costs = {f"{c}_cost": F.col(f"{c}_weight").cast("double") / 1000.0 * F.col(f"__p_{c}")
             for c, _ in COMPONENT_MATERIAL}
    out = out.withColumns(costs)
    return out.withColumn("material_cost", sum((F.col(f"{c}_cost") for c, _ in COMPONENT_MATERIAL), F.lit(0.0)))


def cost_table(specs: DataFrame, book: DataFrame, key: str = "spec_id") -> DataFrame:
    """A10 / Q6: per spec, one row per component plus a 'Total Raw Materials' row
    (summed cost, the spec's own total weight, the first component's price date).
    The total is a row-wise sum of the spec's own components, so the table is a
    narrow stack of six rows per spec -- no grouping shuffle."""
    wide = spec_costs_wide(specs, book)
    rows = [F.struct(F.initcap(F.lit(c)).alias("material"), F.col(f"{c}_weight").cast("double").alias("weight_kg"),
                     F.col(f"{c}_cost").alias("cost_usd"), F.col(f"__d_{c}").alias("price_date"),
                     F.lit(i).alias("row_order"))
            for i, (c, _) in enumerate(COMPONENT_MATERIAL)]
    first = COMPONENT_MATERIAL[0][0]
    rows.append(F.struct(F.lit(TOTAL_LABEL).alias("material"), F.col("total_weight").cast("double").alias("weight_kg"),
                         F.col("material_cost").alias("cost_usd"), F.col(f"__d_{first}").alias("price_date"),
                         F.lit(len(COMPONENT_MATERIAL)).alias("row_order")))
    return wide.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def material_cost_total(specs: DataFrame, book: DataFrame, key: str = "spec_id") -> DataFrame:
    """Total raw-material cost per spec (input of Q8), computed in the spec's row."""
    return spec_costs_wide(specs, book).select(key, "material_cost")


# --- J3: fuzzy material names --------------------------------------------------------------

#: Characters of the grams that a book is indexed by.
GRAM = 3


def contained_in(names: DataFrame, book: DataFrame) -> DataFrame:
    """Each of the distinct ``names`` (``name``) with every row of ``book`` whose ``material`` it contains,
    by an equality join: a material is indexed under the one of its grams that fewest
    materials share (a shorter material under itself), a name meets the materials of its
    own grams, and containment decides."""
    size = F.char_length("material")
    starts = F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1)))
    grams = book.withColumn("gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("material"), i, F.lit(GRAM))))))
    uses = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    index = grams.join(uses, "gram").groupBy(*book.columns).agg(F.min_by("gram", F.struct("uses", "gram")).alias("gram"))

    def grams_of(k: int):
        starts = F.sequence(F.lit(1), F.greatest(F.char_length("name") - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col("name"), i, F.lit(k)))
    parts = names.withColumn("gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[grams_of(k) for k in range(1, GRAM + 1)]))))
    return parts.join(index, "gram").where(F.instr(F.col("name"), F.col("material")) > 0).drop("gram")


def resolve_materials(items: DataFrame, book: DataFrame, col: str = "material") -> DataFrame:
    """Map free-text material names to price-book materials: exact name, else
    the first book material (book order) contained in the name, else keyword
    rules, else steel.  Works on the distinct names (a small set), then joins the
    mapping back by name; adds ``resolved_material`` and ``price``/``price_date``."""
    names = items.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    bk = book.select("material", "book_order")
    exact = names.join(bk.withColumnRenamed("material", "name"), "name", "left")
    contained = (contained_in(exact.where(F.col("book_order").isNull()).select("name"), bk)
                 .groupBy("name").agg(F.min_by("material", "book_order").alias("by_contains")))
    rule = None
    for words, target in K.MATERIAL_KEYWORD_RULES:
        cond = None
        for w in words:
            c = F.instr(F.col("name"), F.lit(w)) > 0
            cond = c if cond is None else cond | c
        rule = F.when(cond, F.lit(target)) if rule is None else rule.when(cond, F.lit(target))
    rule = rule.otherwise(F.lit(K.MATERIAL_FALLBACK))
    mapping = (exact.join(contained, "name", "left")
               .select("name", F.when(F.col("book_order").isNotNull(), F.col("name"))
                       .otherwise(F.coalesce(F.col("by_contains"), rule)).alias("resolved_material")))
    prices = book.select(F.col("material").alias("resolved_material"), "price", "price_date")
    return (items.join(mapping.withColumnRenamed("name", col), col, "left")
                 .join(prices, "resolved_material", "left"))


# --- J5: feed priority ------------------------------------------------------------------------

FEED_PRIORITY = [("api", 0), ("web", 1), ("default", 2)]


def merge_price_feeds(quotes: DataFrame, feed_col: str = "feed") -> DataFrame:
    """Per material, the API price, else the web price, else the default;
    within a feed the latest quote (then the highest quote id).  One aggregate
    with ``min_by`` over a composite key, so a hot material is combined map-side
    rather than ranked inside one window partition."""
    pri = lookup(F.col(feed_col), FEED_PRIORITY, 99)
    order = F.struct(pri.alias("p"), (-F.datediff(F.col("price_date"), F.lit("1970-01-01"))).alias("d"),
                     (-F.col("quote_id")).alias("q"))
    best = quotes.groupBy("material").agg(
        F.min_by(F.struct("price", "unit", "price_date", F.col(feed_col).alias("feed"), "quote_id"),
                 order).alias("b"),
        F.count(F.lit(1)).alias("n_quotes"))
    return best.select("material", "b.*", "n_quotes")


# --- Q10: staleness -------------------------------------------------------------------------

def staleness(book: DataFrame, as_of: str, days: int = K.STALE_DAYS) -> DataFrame:
    """Q10: per material, age in days at ``as_of`` and whether it is stale
    (age >= ``days``; a missing date counts as stale)."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.col("price_date"))
    return book.withColumns({"age_days": age, "is_stale": F.coalesce(age >= days, F.lit(True))})


# --- J6: metrics lookup with defaults ----------------------------------------------------------

def metrics_with_defaults(requested: DataFrame, metrics: DataFrame, name: str = "model") -> DataFrame:
    """Stored metrics per requested model; missing ones get the placeholder
    values and ``is_default`` = true so they cannot pass for results."""
    m = metrics.select(name, *[F.col(c).alias(f"__{c}") for c in K.DEFAULT_METRICS])
    j = requested.join(m, name, "left")
    cols = {c: F.coalesce(F.col(f"__{c}"), F.lit(v)) for c, v in K.DEFAULT_METRICS.items()}
    return (j.withColumns(cols).withColumn("is_default", F.col(f"__{next(iter(K.DEFAULT_METRICS))}").isNull())
             .drop(*[f"__{c}" for c in K.DEFAULT_METRICS]))
