"""HTML listing scan (S10, S11) and metal prices in page text (X13), over a
table of pages ``(…, url, html)``.

Fetching is outside the engine: pages arrive as rows (crawl output, WARC
extracts), so parsing is a set-at-a-time projection: first ``<table class="table">``
of each page -> its ``<tr>`` rows (header skipped) -> ``<td>`` cells with tags
stripped -> typed listing columns.  Pages whose listing table holds further tables
take a second path that follows the nesting: the listing ends at its own ``</table>``, nested
rows are rows too, and a cell's text and a row's cells include those nested in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..session import materialize

# class="... table ...", with either quote or none
TABLE_RE = (r"""(?is)<table\b[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?table(?:\s[^"]*)?"|'(?:[^']*\s)?table(?:\s[^']*)?'|table\b)"""
            r"[^>]*>(.*?)</table>")
#: The listing table's own start tag, and where its text may be cut into pieces that begin with a tag.
OPEN_RE = TABLE_RE.removesuffix("(.*?)</table>")
PIECES_RE = r"(?i)(?=</?(?:table|tr|td)\b)"
PIECE_TAG_RE = r"(?i)^<(/?(?:table|tr|td))\b"
ROW_RE = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL_RE = r"(?is)<td\b[^>]*>(.*?)</td>"
TAG_RE = r"<[^>]+>"
# FIXED VALUES: the character entities decoded in cell text
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def cell_text(c: Column) -> Column:
    t = F.regexp_replace(c, TAG_RE, "")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(t)


def _flat_rows(pages: DataFrame, keep: list[str], table: str) -> DataFrame:
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(table), F.lit(ROW_RE), 1)).alias("row_index", "tr"))
    rows = rows.where(F.col("row_index") >= 1)
    return rows.select(*keep, "row_index", F.transform(F.regexp_extract_all(F.col("tr"), F.lit(CELL_RE), 1), cell_text).alias("cells"))


def _nested_rows(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """The same of pages with tables inside the listing table.  The text from the listing's start
    tag on is cut into pieces at table, row and cell tags; running sums over the pieces of a
    page tell how deep in tables each lies, and a row or cell ends at the next tag of its
    depth that closes it."""
    pages = materialize(pages.withColumn("__page", F.monotonically_increasing_id()), "nested_pages")   # written: the numbers stay
    rest = F.substring(F.col(html), F.regexp_instr(F.col(html), F.lit(OPEN_RE)), F.length(html))
    pieces = pages.select("__page", F.posexplode(F.split(rest, PIECES_RE)).alias("at", "piece"))
    pieces = pieces.withColumn("tag", F.lower(F.regexp_extract("piece", PIECE_TAG_RE, 1)))
    so_far = Window.partitionBy("__page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("tag") == "table", 1).when(F.col("tag") == "/table", -1).otherwise(0)
    pieces = pieces.withColumn("after", F.sum(step).over(so_far))
    # the closing tag of a table counts as the last of its depth; nothing after the listing's own counts
    pieces = pieces.withColumn("depth", F.col("after") + F.when(F.col("tag") == "/table", 1).otherwise(0))
    pieces = materialize(pieces.withColumn("open", F.min("after").over(so_far)).where("open > 0 or (tag = '/table' and after = 0)")
                         .withColumn("first_end", F.min(F.when(F.col("after") == 0, F.col("at"))).over(Window.partitionBy("__page")))
                         .where("first_end is null or at <= first_end"), "html_pieces")

    def spans(opening: str, closing: list[str]) -> DataFrame:
        following = Window.partitionBy("__page", "depth").orderBy("at")
        marks = pieces.where(F.col("tag").isin(opening, *closing))
        return (marks.withColumn("end", F.coalesce(F.lead("at").over(following), F.lit((1 << 31) - 1))).where(F.col("tag") == opening)
                .select(F.col("__page").alias("of"), F.col("at").alias("begin"), "end"))
    cells = spans("td", ["/td", "tr", "/tr", "/table"])
    texts = (pieces.join(cells, (F.col("__page") == F.col("of")) & (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
             .groupBy("of", "begin").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
             .select(F.col("of").alias("page"), F.col("begin").alias("place"),
                     cell_text(F.array_join(F.transform("parts", lambda x: x["piece"]), "")).alias("text")))
    rows = spans("tr", ["/tr", "/table"])
    number = F.row_number().over(Window.partitionBy("of").orderBy("begin")) - 1
    rows = rows.withColumn("row_index", number).where("row_index >= 1")
    found = (rows.join(texts, (F.col("page") == F.col("of")) & (F.col("place") > F.col("begin")) & (F.col("place") < F.col("end")), "left")
             .groupBy("of", "row_index").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("c"))
             .select(F.col("of").alias("__page"), "row_index", F.transform(F.filter("c", lambda x: x["place"].isNotNull()), lambda x: x["text"]).alias("cells")))
    return pages.join(found, "__page").select(*keep, "row_index", "cells")


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns…, row_index, cells array<string>) for every data row of the
    first listing table; the header row (index 0) is skipped."""
    keep = [c for c in pages.columns if c != html]
    found = pages.withColumn("__table", F.regexp_extract(F.col(html), TABLE_RE, 1))
    nested = F.coalesce(F.regexp_like("__table", F.lit(r"(?i)<table\b")), F.lit(False))
    some = found.where(nested).drop("__table")
    flat = _flat_rows(found.where(~nested), keep, "__table")
    return flat if some.isEmpty() else flat.unionByName(_nested_rows(some, keep, html))


def scan_listings(pages: DataFrame, url: str = "url", html: str = "html", scrape_date: str | None = None) -> DataFrame:
    """S10 + S11: listing rows from every page.  Rows with fewer than five cells,
    non-equipment descriptions (C8) or an unparsable number are dropped."""
    r = table_rows(pages, html).where(F.size("cells") >= 5)
    cell = lambda i: F.coalesce(F.try_element_at(F.col("cells"), F.lit(i + 1)), F.lit(""))
    out = r.select(
        *[c for c in r.columns if c not in ("cells",)],
        cell(0).alias("date"), cell(1).alias("hsn_code"), cell(2).alias("description"),
        cell(3).alias("origin"), cell(4).alias("quantity_text"), cell(5).alias("price_text"))
    out = X.compute_once(out, {"__lo": F.lower(F.col("description"))})
    out = out.where(X.is_equipment_loose(F.col("__lo"), cased=True))
    qty_raw, price_raw = F.col("quantity_text"), F.regexp_replace(F.col("price_text"), r"[^\d.,]", "")
    out = X.compute_once(out, {"__token": X.loose_rating_token(F.col("__lo"), cased=True)})
    out = X.compute_once(out, {
        "destination": X.destination_from_url(F.col(url)),
        "quantity": X.first_number(qty_raw),
        "unit_price_usd": X.first_number(price_raw),
        "power_rating_kva": X.loose_rating_of(F.col("__token")),
        "source_url": F.col(url),
        "__number": X.first_number_is_bad(qty_raw) | X.first_number_is_bad(price_raw),
    })
    out = out.withColumn("__bad", F.col("__number") | (F.col("__token").isNotNull() & F.col("power_rating_kva").isNull()))
    out = out.where(~F.col("__bad")).drop("quantity_text", "price_text", "__lo", "__token", "__number", "__bad")
    if scrape_date is not None:
        out = out.withColumn("scrape_date", F.to_date(F.lit(scrape_date)))
    return out


def metal_prices(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """First '<Metal> 1,234.56' quote of each metal per page, as rows
    (key, material, price)."""
    items = []
    for material, label in K.PAGE_METAL_LABELS:
        pat = label + r"\s+(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"
        val = F.replace(F.nullif(F.regexp_extract(F.col(html), pat, 1), F.lit("")), F.lit(","), F.lit(""))
        items.append(F.struct(F.lit(material).alias("material"), val.try_cast("double").alias("price")))
    return (pages.select(key, F.explode(F.array(*items)).alias("m"))
                 .select(key, "m.material", "m.price").where(F.col("price").isNotNull()))
