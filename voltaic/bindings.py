"""Derived inputs over the driver's tables.

The driver's tables hold no equipment text, so the operators run on views derived
from them with SQL that means the same in Spark and DuckDB.  Each binding is one
SQL text with ``{table}`` placeholders and ``{S}`` for the string type; Spark reads
``parquet.`<dir>/<table>.parquet``` directly (no session-global temp views), the
oracle reads the pre-registered DuckDB views.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import constants as K

LAYOUT_VERSION = "2"  # bump when the materialised layout changes

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Binding L: one trade listing per line item, with raw text fields.
LISTINGS = """
select l.l_orderkey, l.l_linenumber, l.l_partkey,
  cast(l.l_shipdate as date) as listing_date,
  concat('850423', cast(p.p_partkey % 6 as {S}), '0') as hsn_code,
  sn.n_name as origin, cn.n_name as destination,
  case l.l_linenumber % 4 when 0 then cast(cast(l.l_quantity as int) as {S})
    when 1 then concat(cast(cast(l.l_quantity as int) as {S}), ' NOS') when 2 then null else 'PAC' end as quantity,
  concat('$ ', cast(l.l_extendedprice as {S})) as unit_price,
  concat(p.p_name, ' ', case p.p_partkey % 5
    when 0 then concat(cast(p.p_size*100 as {S}), ' KVA 33KV/433V')
    when 1 then concat(cast(p.p_size as {S}), '.5MVA 132/33KV')
    when 2 then concat(cast(p.p_size*100 as {S}), 'KVA 11KV TO 400V')
    when 3 then 'led lamp' else concat(cast(p.p_size as {S}), ' MVA 3 phase power') end,
    ' transformer ', lower(p.p_type),
    case l.l_orderkey % 6 when 0 then ' single phase distribution unit 60 Hz'
      when 1 then ' oil filled step-down, for USA grid' when 2 then ' dry type 50hz'
      when 3 then ' 1-phase auto transformer' else '' end) as description
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on p.p_partkey = l.l_partkey
  join {supplier} s on s.s_suppkey = l.l_suppkey join {customer} c on c.c_custkey = o.o_custkey
  join {nation} sn on sn.n_nationkey = s.s_nationkey join {nation} cn on cn.n_nationkey = c.c_nationkey
"""

# The same rows with the joins in the order that Spark runs best: an order's destination is found
# before it meets its line items, and the texts of parts join last, so that no row is shuffled
# with its texts.  The line items are dealt out by their order, for the join and the files at once.
SPARK_LISTINGS = LISTINGS[:LISTINGS.index("from {lineitem}")] + """
from (select /*+ REPARTITION(files, l_orderkey) */ l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice from {lineitem}) l
  join (select o.o_orderkey, n.n_name from {orders} o join {customer} c on c.c_custkey = o.o_custkey
    join {nation} n on n.n_nationkey = c.c_nationkey) cn on cn.o_orderkey = l.l_orderkey
  join {supplier} s on s.s_suppkey = l.l_suppkey join {nation} sn on sn.n_nationkey = s.s_nationkey
  join {part} p on p.p_partkey = l.l_partkey
"""

# Binding S: one transformer specification per part.
SPECS = """
select p_partkey as spec_id,
  cast(p_size * (case p_partkey % 4 when 0 then 10 when 1 then 100 when 2 then 1000 else 4000 end) as double) as power_rating,
  cast(case p_partkey % 5 when 0 then 6.6 when 1 then 11.0 when 2 then 33.0 when 3 then 132.0 else 230.0 end as double) as primary_voltage,
  cast(case p_partkey % 3 when 0 then 0.4 when 1 then 0.433 else 11.0 end as double) as secondary_voltage,
  case p_partkey % 2 when 0 then 'Three-phase' else 'Single-phase' end as phase,
  case p_partkey % 7 when 0 then 'ONAN' when 1 then 'ONAF' when 2 then 'OFAF' else 'ODAF' end as cooling_type,
  p_partkey % 3 = 0 as tap_changer,
  cast(0.95 + (p_partkey % 5) * 0.01 as double) as efficiency,
  case p_partkey % 4 when 0 then 'North America' when 1 then 'Europe' when 2 then 'Asia' else 'South America' end as manufacturing_location,
  case p_partkey % 6 when 0 then 'Dry' else 'Oil' end as insulation_type,
  case p_partkey % 2 when 0 then 'Outdoor' else 'Indoor' end as installation_type,
  cast(case p_partkey % 5 when 4 then 60 else 50 end as int) as frequency,
  cast(p_retailprice as double) * 100 as quoted_price
from {part}
"""

# Binding Q: material price quotes from three feeds, one per order.
QUOTES = """
select o_orderkey as quote_id,
  case o_orderkey % 9 when 0 then 'copper' when 1 then 'aluminum' when 2 then 'steel' when 3 then 'zinc'
    when 4 then 'nickel' when 5 then 'lead' when 6 then 'electrical_steel' when 7 then 'mineral_oil'
    else 'insulation_materials' end as material,
  case o_custkey % 3 when 0 then 'api' when 1 then 'web' else 'default' end as feed,
  cast(floor(o_totalprice * 5) as double) / 100 as price,
  'USD/Ton' as unit,
  cast(o_orderdate as date) as price_date
from {orders}
"""

# Binding C: component bills of material (free-text material names) per line item.
BOM = """
select l_orderkey, l_linenumber, l_partkey,
  case l_linenumber % 7 when 0 then 'copper_wire' when 1 then 'core laminations' when 2 then 'coil winding'
    when 3 then 'insulation paper' when 4 then 'tank plate' when 5 then 'transformer oil' else 'bolts' end as material,
  cast(l_quantity * 10 as double) as weight_kg
from {lineitem}
"""

# Binding H: one listing page per listing row (flat HTML table).
PAGES = """
select l_orderkey, l_linenumber, l_partkey,
  concat('https://x/import/import-in-', lower(replace(destination, '_', '-')), '/') as url,
  concat('<html><body><h1>Imports</h1><table class="table"><tr><th>Date</th><th>HSN</th><th>Description</th>',
    '<th>Origin</th><th>Qty</th><th>Price</th></tr><tr><td>', cast(listing_date as {S}), '</td><td>', hsn_code,
    '</td><td>', description, '</td><td> ', origin, ' </td><td>', coalesce(quantity, ''), '</td><td>',
    unit_price, '</td></tr><tr><td>short</td></tr></table></body></html>') as html
from listings
"""

# Binding E: exchange pages quoting metal prices in text.
EXCHANGE_PAGES = """
select o_orderkey as page_id,
  concat('<html><body><p>LME Copper ',
    case when o_totalprice >= 10000 then concat(cast(cast(floor(o_totalprice / 10000) as bigint) as {S}), ',',
      lpad(cast(cast(floor(o_totalprice / 10) as bigint) % 1000 as {S}), 3, '0'))
      else cast(cast(floor(o_totalprice / 10) as bigint) as {S}) end,
    '.', lpad(cast(cast(floor(o_totalprice * 10) as bigint) % 100 as {S}), 2, '0'), ' USD/t</p>',
    '<p>Aluminium ', cast(cast(floor(o_totalprice / 40) as bigint) as {S}), '.',
    lpad(cast(cast(floor(o_totalprice * 2.5) as bigint) % 100 as {S}), 2, '0'), '</p>',
    case o_orderkey % 2 when 0 then concat('<p>Zinc ', cast(cast(floor(o_totalprice / 35) as bigint) as {S}), '</p>') else '' end,
    '<p>Lead ', cast(cast(floor(o_totalprice) as bigint) % 3000 as {S}), '</p></body></html>') as html
from {orders}
"""


def render(sql: str, dialect: str, sf_dir: str | None = None) -> str:
    """Fill table and type placeholders for ``spark`` or ``duckdb``."""
    if dialect == "spark":
        tables = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}
        string_type = "string"
    else:
        tables = {t: t for t in TABLES}
        string_type = "varchar"
    return sql.format(S=string_type, **tables)


#: Input bytes behind a file of a materialised binding, at most about.
BYTES_PER_FILE = 64 << 20
#: Shuffled bytes of a join's smaller side in a task up to which the task hashes them.
HASH_JOIN, HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"


@contextlib.contextmanager
def hashed_joins(spark: SparkSession):
    """Within it a shuffled join hashes its smaller side where that fits (``HASHED``), so that the other
    side, with most of the rows, is not sorted, nor spilled when a task's share outgrows memory."""
    before = spark.conf.get(HASH_JOIN)
    spark.conf.set(HASH_JOIN, HASHED)
    try:
        yield
    finally:
        spark.conf.set(HASH_JOIN, before)


def _input_version(spark: SparkSession, sf_dir: str, sql: str) -> str:
    """Latest modification time and total size of the tables a binding reads."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for t in TABLES:
        if f"/{t}.parquet`" in sql:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
            fs = path.getFileSystem(conf)
            for s in fs.listStatus(path):
                found.append(f"{s.getPath().getName()}:{s.getModificationTime()}:{s.getLen()}")
    return "\n".join(sorted(found))


def materialized(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """Run a binding once and keep it as a parquet table under the shared
    ``spark.checkpoint.dir`` (keyed by input folder, its files' versions and the SQL text):
    later queries scan it with pruning and pushdown instead of re-running the joins, and the
    lineage is cut.  It is written under another name first, so a table that is there is
    whole, with or without marker files.  A text that deals out its own rows
    (``REPARTITION``) is written as it comes."""
    from .session import min_partitions, scratch_path, shuffles_freed
    version = _input_version(spark, sf_dir, sql)
    key = hashlib.sha1("\n".join([LAYOUT_VERSION, sf_dir, version, sql]).encode()).hexdigest()[:16]
    path = scratch_path(spark, f"binding_{name}_{key}")
    done = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        part = f"{path}_{uuid.uuid4().hex[:8]}"
        size = sum(int(line.rsplit(":", 1)[1]) for line in version.splitlines())
        files = max(min_partitions(spark), size // BYTES_PER_FILE)
        dealt = "REPARTITION(files, "
        rows = spark.sql(sql.replace(dealt, f"REPARTITION({files}, "))
        if dealt not in sql:
            rows = rows.repartition(files)
        with hashed_joins(spark), shuffles_freed(spark):
            rows.write.mode("overwrite").parquet(part)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), done) and not fs.exists(done):
            raise RuntimeError(f"cannot move {part} to {path}")
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "listings", render(SPARK_LISTINGS, "spark", sf_dir))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "specs", render(SPECS, "spark", sf_dir))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "quotes", render(QUOTES, "spark", sf_dir))


def bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "bom", render(BOM, "spark", sf_dir))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = render(PAGES, "spark", sf_dir).replace(
        "from listings", "from (" + render(SPARK_LISTINGS, "spark", sf_dir) + ") listings")
    return materialized(spark, sf_dir, "pages", sql)


def exchange_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "exchange_pages", render(EXCHANGE_PAGES, "spark", sf_dir))


def price_book(spark: SparkSession) -> DataFrame:
    """The default price book as a 9-row dimension (material, price, unit, price_date, book_order)."""
    rows = [(m, p, u, d, i) for i, (m, p, u, d) in enumerate(K.PRICE_BOOK)]
    return spark.createDataFrame(
        rows, "material string, price double, unit string, price_date string, book_order int"
    ).selectExpr("material", "price", "unit", "cast(price_date as date) as price_date", "book_order")


# DuckDB text of the same bindings, used by the oracle.
def duck_ctes(*names: str) -> str:
    parts = []
    for n in names:
        if n == "price_book":
            vals = ", ".join(f"('{m}', cast({p} as double), '{u}', date '{d}', {i})"
                             for i, (m, p, u, d) in enumerate(K.PRICE_BOOK))
            parts.append(f"price_book as (select * from (values {vals}) "
                         "t(material, price, unit, price_date, book_order))")
        elif n == "pages_listing":
            parts.append("pages_listing as (" + render(PAGES, "duckdb") + ")")
        else:
            sql = {"listings": LISTINGS, "specs": SPECS, "quotes": QUOTES, "bom": BOM,
                   "exchange_pages": EXCHANGE_PAGES}[n]
            parts.append(f"{n} as ({render(sql, 'duckdb')})")
    return "with " + ",\n".join(parts) + "\n"
