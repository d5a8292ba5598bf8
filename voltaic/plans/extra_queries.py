"""Queries on inputs that reach every branch: near-empty listings, null, zero and unreadable
prices, overweight specs, pages with tables; display forms, whole-column fills, late
files, saved unions, the trend curve and the chart ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bindings as B
from .. import constants as K
from ..operators import clean, extract, prepare, stats, topk
from ..session import scratch_path
from ..sources import files as FS
from ..sources import html as H
from . import dataset_queries as DQ
from . import listing_queries as LQ
from . import source_queries as SQ
from . import sqlfrag as S
from .registry import query, r

# Listings as they come: fields missing, prices absent, zero or without a number.
RAGGED = """
select l_orderkey, case when l_orderkey % 11 = 0 then null else listing_date end as listing_date,
  case when l_orderkey % 11 = 0 then null else hsn_code end as hsn_code,
  case when l_orderkey % 11 = 0 then null else origin end as origin,
  case when l_orderkey % 22 = 0 then null else description end as description,
  case l_orderkey % 7 when 0 then null when 1 then '$ 0' when 2 then 'on request' else unit_price end as unit_price
from {listings}
"""
RAGGED_SQL = B.duck_ctes("listings").rstrip() + ",\nragged as (" + RAGGED.format(listings="listings") + ")\n"


def ragged(spark, sf):
    return spark.sql(RAGGED.format(listings="{listings}"), listings=B.listings(spark, sf))


@query("clean_thresh_ragged", RAGGED_SQL + """
select l_orderkey, count(*) as n from ragged
where (case when listing_date is not null then 1 else 0 end) + (case when hsn_code is not null then 1 else 0 end)
  + (case when origin is not null then 1 else 0 end) + (case when description is not null then 1 else 0 end)
  + (case when unit_price is not null then 1 else 0 end) >= 2 group by l_orderkey""")
def clean_thresh_ragged(spark, sf):
    """C1 where it drops rows: listings with fewer than two filled fields go."""
    df = clean.drop_sparse_rows(ragged(spark, sf).withColumnRenamed("l_orderkey", "k"), subset=["listing_date", "hsn_code", "origin", "description", "unit_price"])
    return df.groupBy(F.col("k").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_price_ragged", RAGGED_SQL + f"""
, p as (select *, {S.parse_price('unit_price')} as price from ragged)
select count(*) as rows_in, count(*) filter (where price is null) as null_price,
  count(*) filter (where price <= 0) as non_positive_price, count(*) filter (where price > 0) as rows_kept from p""")
def clean_price_ragged(spark, sf):
    """C2 + C9 where prices are null, zero or unreadable."""
    return clean.positive_price_report(clean.clean_price(ragged(spark, sf)))


HEAVY = "select spec_id, " + ", ".join(
    f"{c}_weight * (case when spec_id % 9 = 0 then 50.0 else 1.0 end) as {c}_weight" for c in [*K.COMPONENT_NAMES, "total"]) + " from {weighted}"


def _heavy_sql():
    from .spec_queries import W_SQL
    return W_SQL.rstrip() + ",\nheavy as (" + HEAVY.format(weighted="weighted") + ")\n"


@query("clean_overweight", _heavy_sql() + """
select spec_id, greatest(core_weight, copper_weight, insulation_weight, tank_weight, oil_weight, total_weight) > 1000000.0
  as implausible_weight from heavy""")
def clean_overweight(spark, sf):
    """C13 on specs some of which exceed the limit."""
    from .spec_queries import weighted
    heavy = spark.sql(HEAVY.format(weighted="{weighted}"), weighted=weighted(spark, sf))
    return clean.implausible_weight_flag(heavy).select("spec_id", "implausible_weight")


# The crawled pages, each with a listing table put into its body; every third has another table only.
TABLE_PAGES = """
select page_id, concat('https://x/import/import-in-', case page_id % 4 when 0 then 'united-kingdom' when 1 then 'nepal' when 2 then 'sri-lanka' else 'italy' end,
    case when page_id % 2 = 0 then '/' else '' end) as url,
  concat(html, '<table id=t class=', case page_id % 3 when 0 then '"wide table"' when 1 then '''table''' else '"data"' end,
    '><tr><th>Date</th></tr><tr><td>2024-01-02</td><td>8504</td><td>', cast(page_id % 50 + 1 as {S}), ' MVA <b>transformer</b> &amp; parts</td><td>India</td><td>',
    case page_id % 5 when 0 then '2 NOS' when 1 then '' else '3' end, '</td><td>', case page_id % 4 when 0 then '' when 1 then '$1,250.50' when 2 then '0' else '1.2.3' end,
    '</td></tr><tr><td>x</td><td>1</td><td>garden chair</td><td>y</td><td>1</td></tr></table>') as html
from {pages}
"""
TABLE_PAGES_SQL = "with tpages as (" + TABLE_PAGES.format(S="varchar", pages="pages") + "),\n"


def table_pages(spark, sf):
    return spark.sql(TABLE_PAGES.format(S="string", pages="{pages}"), pages=B.table(spark, sf, "pages"))


@query("html_listings_raw_pages", TABLE_PAGES_SQL + SQ._scan_sql("tpages", "page_id") + f"""
select page_id, cast(row_index as integer) as row_index, description, {r(SQ._num_sql('qt'), 'quantity')}, {r(SQ._num_sql('pr'), 'unit_price_usd')},
  {r(SQ._loose_rating_sql('description'), 'power_rating_kva')}, date '2025-03-19' as scrape_date
from pp where not {SQ._bad_num_sql('qt')} and not {SQ._bad_num_sql('pr')} and not {SQ._loose_rating_sql('description', True)}""")
def html_listings_raw_pages(spark, sf):
    """S10, S11 with the scrape date over the crawled pages, a table in each."""
    out = H.scan_listings(table_pages(spark, sf), scrape_date="2025-03-19")
    return out.select("page_id", "row_index", "description", "quantity", "unit_price_usd", "power_rating_kva", "scrape_date")


@query("html_destination", TABLE_PAGES_SQL + f"""
u as (select page_id, {S.extract('url', K.DESTINATION_URL_PATTERN)} as d from tpages)
select page_id, {S.initcap("replace(d, '-', ' ')")} as destination from u""")
def html_destination(spark, sf):
    """The destination of every page's URL."""
    from ..functions.text import destination_from_url
    return table_pages(spark, sf).select("page_id", destination_from_url(F.col("url")).alias("destination"))


@query("prepare_display", B.duck_ctes("quotes") + f"""
select quote_id, {S.initcap("replace(material, '_', ' ')")} as material, '$' || format('{{:,.2f}}', price) as price,
  {r(f'price / {K.LB_PER_TON} * {K.LB_PER_TON}', 'usd_per_ton')} from quotes""")
def prepare_display(spark, sf):
    """Per-pound prices to tons; money and names as shown."""
    q = B.quotes(spark, sf).withColumn("per_lb", F.col("price") / K.LB_PER_TON)
    return q.select("quote_id", prepare.display_name("material").alias("material"), prepare.money("price").alias("price"),
                    prepare.usd_per_lb_to_ton("per_lb").alias("usd_per_ton"))


@query("prepare_volts", B.duck_ctes("specs") + f"""
select spec_id, {r('primary_voltage * 1000.0', 'primary_volts')} from specs""")
def prepare_volts(spark, sf):
    """kV to volts."""
    return B.specs(spark, sf).select("spec_id", prepare.kv_to_volts("primary_voltage").alias("primary_volts"))


@query("prepare_fill_columns", B.duck_ctes("specs") + f"""
select spec_id, {K.DEFAULT_FREQUENCY} as frequency_hz, '{K.DEFAULT_PHASE}' as phase, '{K.DEFAULT_TYPE}' as type,
  {K.DEFAULT_PRIMARY_KV} as primary_voltage_kv, {r('secondary_voltage', 'secondary_voltage_kv')} from specs""")
def prepare_fill_columns(spark, sf):
    """Columns that are absent appear with their defaults, others stay."""
    df = B.specs(spark, sf).select("spec_id", F.col("secondary_voltage").alias("secondary_voltage_kv"))
    out = prepare.fill_defaults(df)
    return out.select("spec_id", "frequency_hz", "phase", "type", "primary_voltage_kv", "secondary_voltage_kv")


@query("files_latest", """
with m as (select distinct strftime(cast(o_orderdate as date), '%Y%m') || '01' as stamp from orders)
select max(stamp) as by_name, min(stamp) as by_mtime, count(*) as n_files from m""")
def files_latest(spark, sf):
    """All orders land in one file per month, the first month's delivered late: the
    newest by name is the last month, the newest by modification time the late one."""
    orders = B.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM01").alias("stamp"))
    base = scratch_path(spark, f"landing_{uuid.uuid4().hex[:12]}")
    late = orders.agg(F.min("stamp")).first()[0]
    for part in (F.col("stamp") > late, F.col("stamp") == late):
        orders.where(part).repartition("stamp").write.mode("append").partitionBy("stamp").option("header", True).csv(base)
    found = FS.list_files(spark, base, "*.csv")

    def stamp(path):
        return path.split("stamp=")[1][:8] if path else None
    return spark.createDataFrame(
        [(stamp(FS.latest_by_name(spark, base, "*.csv", r"stamp=(\d{8})")), stamp(FS.latest_by_mtime(spark, base, "*.csv")), found.count())],
        "by_name string, by_mtime string, n_files bigint")


@query("union_saved", DQ.INTEGRATED + """
select data_source, count(*) as n, count(distinct power_rating_kva) as ratings from integrated group by data_source""")
def union_saved(spark, sf):
    """The integrated table saved as CSV and read back; without a shared column the left input."""
    whole = DQ.integrated(spark, sf)
    sources = [whole.where(F.col("data_source") == s) for s in (K.SOURCE_REAL, K.SOURCE_SYNTHETIC)]
    path = scratch_path(spark, f"union_{uuid.uuid4().hex[:12]}")
    out = prepare.union_common_saved(*sources, path)
    back = FS.read_csv(spark, path, prepare.to_display(out).schema)
    left = prepare.union_common_saved(back, spark.range(1).withColumnRenamed("id", "nothing_shared"), path + "_left")
    return left.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("power_rating_kva").alias("ratings"))


@query("stats_quadratic_curve", DQ.INTEGRATED + DQ._quad_sql() + f"""
, g as (select (select min(x) from base) as lo, (select max(x) from base) as hi),
c as (select aa / (sx * sx) as a, bb / sx - 2 * aa * mx / (sx * sx) as b, aa * mx * mx / (sx * sx) - bb * mx / sx + cc as c from abc),
p as (select i, lo + i * (hi - lo) / 99 as x, a, b, c from g, c, range(100) t(i))
select cast(i as integer) as i, {r('x', 'x', 3)}, {r('a * x * x + b * x + c', 'fitted', 2)} from p""")
def stats_quadratic_curve(spark, sf):
    """The 100 fitted points of the trend."""
    from .registry import round_half_up
    _, curve = stats.quadratic_trend(DQ.integrated(spark, sf), "power_rating_kva", "unit_price_usd")
    return curve.select("i", round_half_up(F.col("x"), 3).alias("x"), round_half_up(F.col("fitted"), 2).alias("fitted"))


def _side(side: str, order: str, k: int) -> str:
    return (f"select feature, correlation, '{side}' as side, row_number() over (order by correlation {order}, feature) as rk from corrs "
            f"where correlation is not null and not isnan(correlation) qualify rk <= {k}")


@query("topk_chart", DQ.CORR_SQL + f"""
, s as ({_side('top', 'desc', 10)} union all {_side('bottom', 'asc', 10)})
select feature, {r('correlation', 'correlation')}, side, cast(rk as integer) as rank, count(*) over (partition by side) - rk + 1 as place from s""")
def topk_chart(spark, sf):
    """The chart's ten highest and ten lowest correlations, each side reversed."""
    return topk.chart_set(DQ.spec_correlations(spark, sf), "correlation", "feature", 10)


@query("extract_phase_only", LQ.LST + f"""
select l_orderkey, l_linenumber, l_partkey, coalesce({S.phase('description')}, '{K.DEFAULT_PHASE}') as phase from listings""")
def extract_phase_only(spark, sf):
    """X7 + P3 for a table that has a type but no phase."""
    df = extract.add_phase(B.listings(spark, sf).withColumn("type", F.lit("Power")))
    return prepare.fill_defaults(df).select("l_orderkey", "l_linenumber", "l_partkey", "phase")
