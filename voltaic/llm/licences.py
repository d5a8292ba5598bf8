"""Licence scan by canonical digests.

A text's canonical form has lower-case letters, one blank for every run of punctuation and
blanks, one spelling of equivalent words, and no copyright lines or empty lines.  The
SHA-256 of the whole canonical text, and of each whole canonical line, is hash-joined
with the digests of the known licences and notices.  DataFrame functions only.

Results for odd input: a null text has null digest and no licence; an empty text, or one
of copyright lines alone, has the digest of the empty string and no licence; equal rows get
equal results; a null ``doc_id`` is kept; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.session import materialize

from .common import doc_texts
from .licence_texts import KNOWN, SPELLINGS, WHOLE_DIGESTS

#: A-Z and typographic characters, and what they become.
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ“”‘’–—"
TO = "abcdefghijklmnopqrstuvwxyz\"\"''--"
#: ASCII punctuation and blanks, line ends not included.
PUNCTUATION = r"[!-/:-@\[-`{-~ \t\x0b\f\r]+"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that remain."""
    t = F.translate(F.replace(text, F.lit("©"), F.lit("copyright ")), FROM, TO)
    t = F.regexp_replace(F.replace(t, F.lit("(c)"), F.lit("copyright ")), PUNCTUATION, " ")
    for spelling, canonical in SPELLINGS:
        t = F.replace(t, F.lit(spelling), F.lit(canonical))
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(" ")))
    return F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("copyright ")) & ~x.isin("copyright", "all rights reserved"))


def whole(lines: Column) -> Column:
    return F.array_join(lines, " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]], whole_digests: list[tuple[str, str]]) -> DataFrame:
    """(``license_id``, ``known_digest``, ``chars``), one row per known text; ``chars`` is null for
    those of which only the digest is given."""
    def table(rows: list[tuple[str, str]], second: str) -> DataFrame:
        values = [F.struct(F.lit(a).alias("license_id"), F.lit(b).alias(second)) for a, b in rows]
        empty = F.array().cast(f"array<struct<license_id:string,{second}:string>>")
        return spark.range(1).select(F.inline(F.array(*values) if values else empty))
    text = table(known, "text").select("license_id", whole(canonical_lines(F.col("text"))).alias("text"))
    rows = text.select("license_id", digest(F.col("text")).alias("known_digest"), F.char_length("text").alias("chars"))
    return (rows.unionByName(table(whole_digests, "known_digest").withColumn("chars", F.lit(None).cast("int")))
            .groupBy("known_digest").agg(F.min("license_id").alias("license_id"), F.max("chars").alias("chars")))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, whole_digests: list[tuple[str, str]] = WHOLE_DIGESTS) -> DataFrame:
    """One row per document: ``doc_id``, ``digest`` of the whole text, its ``license_id`` (or
    null), ``notice_ids`` (sorted licences of whole lines) and ``n_notices`` (such lines)."""
    spark = docs.sparkSession
    table = materialize(known_digests(spark, known, whole_digests), "licence_known")  # one row a given licence text
    lengths = [r.chars for r in table.select("chars").where("chars is not null").distinct().collect()]
    lengths = F.lit(lengths) if lengths else F.array().cast("array<int>")
    lines = F.col("lines")
    units = (doc_texts(docs).select("doc_id", canonical_lines(F.col("text")).alias("lines"))
             .select("doc_id", digest(whole(lines)).alias("digest"),
                     F.transform(F.filter(lines, lambda x: F.array_contains(lengths, F.char_length(x))), digest).alias("line_digests")))
    units = materialize(units, "licence_units")
    # equal rows have equal notices: they are found once for each different id and list of lines
    lists = units.where(F.size("line_digests") > 0).select(F.col("doc_id").alias("of_id"), F.col("line_digests").alias("of_lines")).distinct()
    notices = (lists.select("of_id", "of_lines", F.explode("of_lines").alias("known_digest"))
               .join(F.broadcast(table), "known_digest")
               .groupBy("of_id", "of_lines", "license_id").agg(F.count("*").alias("n"))
               .groupBy("of_id", "of_lines").agg(F.sort_array(F.collect_list("license_id")).alias("notice_ids"), F.sum("n").alias("n")))
    return (units.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left")
            .join(notices, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("line_digests") == F.col("of_lines")), "left")
            .select("doc_id", "digest", "license_id", F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_notices")))


def oracle(known: list[tuple[str, str]] = KNOWN, whole_digests: list[tuple[str, str]] = WHOLE_DIGESTS) -> str:
    """DuckDB SQL of ``scan`` with ``notice_ids`` joined by commas."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def lines(text: str) -> str:
        t = f"translate(replace({text}, '©', 'copyright '), {quoted(FROM)}, {quoted(TO)})"
        t = f"regexp_replace(replace({t}, '(c)', 'copyright '), {quoted(PUNCTUATION)}, ' ', 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, '{a}', '{b}')"
        return (f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), "
                "lambda x: x <> '' and not starts_with(x, 'copyright ') and x not in ('copyright', 'all rights reserved'))")

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)
    given = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, d in whole_digests)
    return f"""
with known as (select min(id) as id, d from (select id, sha256(array_to_string({lines('t')}, ' ')) as d from (values {values}) v(id, t)
  union all select * from (values {given}) w(id, d)) group by 2),
units as (select row_number() over () as rid, doc_id, {lines('text')} as ls from documents),
notices as (select rid, string_agg(id, ',' order by id) as ids, sum(n) as n from (
  select u.rid, k.id, count(*) as n from (select rid, unnest(ls) as l from units) u join known k on k.d = sha256(u.l) group by 1, 2) group by 1)
select u.doc_id, sha256(array_to_string(u.ls, ' ')) as digest, k.id as license_id, coalesce(n.ids, '') as notice_ids, cast(coalesce(n.n, 0) as bigint) as n_notices
from units u left join known k on k.d = sha256(array_to_string(u.ls, ' ')) left join notices n on n.rid = u.rid"""
