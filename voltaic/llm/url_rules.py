"""URL filters: listed rules, and association rules mined from labelled URLs.

A listed rule (host, path prefix) fits its host and all subdomains; the longest fitting
rule decides.  Other URLs are judged by mined rules: combinations of up to ``max_tokens``
tokens (host labels, words of the path, query parameters) that at least ``min_count``
blocked URLs hold and that imply a block with enough confidence.  A combination with a
rule inside it is never made: tokens that are rules alone leave the URLs, tokens that the
same labelled URLs hold are one item, and Spark's FP-growth runs over what is left of the
blocked URLs.  An inverted index holds each rule under its rarest item; a URL meets the
rules of its items there and is blocked by any whose items it has all.

Results for odd input: a null URL, or one without ``://``, has empty host and path and no
tokens, and is allowed; equal rows get equal results; null labels are ignored and a page
with several labels is bad if any is; a null ``page_id`` is kept; an empty table gives no
rows; without labels nothing is mined, and without listed rules none fits; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.session import materialize

#: A-Z and a-z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "://([^/?#]*)([^?#]*)"
BLOCK, ALLOW = "block", "allow"
#: Most items of a URL that FP-growth takes whole; wider URLs go in as their combinations of one size.
WIDE = 14


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct typed tokens of a URL: words with a letter of any script; numbers are no tokens."""
    def typed(kind: str, parts: Column) -> Column:
        words = F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"\p{L}")))
        return F.transform(words, lambda x: F.concat(F.lit(kind), F.translate(x, UPPER, LOWER)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = F.concat(typed("host:", F.split(host(url), "[.-]")), typed("path:", F.split(path(url), "[/._-]")), typed("query:", F.split(query, "&")))
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def listed(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (``size``, ``rule``, ``verdict``) of the longest fitting rule, else null.
    ``rules`` are (host, path, verdict)."""
    fits = [F.when(((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def items_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with the sorted ``items`` that their ``tokens`` are (``members``: token, item), rows
    without any left out.  ``rows`` have a unique ``key``."""
    found = rows.select("key", F.explode("tokens").alias("token")).join(members, "token").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return rows.join(found, "key")


def subsets(items: str, size: int) -> str:
    """SQL of the combinations of ``size`` elements of a sorted array."""
    if size == 1:
        return f"transform({items}, x1 -> array(x1))"
    inner = subsets(f"slice({items}, i{size} + 2, size({items}))", size - 1)
    return f"flatten(transform({items}, (x{size}, i{size}) -> transform({inner}, y{size} -> array_append(y{size}, x{size}))))"


def combinations(rows: DataFrame, min_count: int, max_tokens: int) -> DataFrame:
    """(``rule``): sorted combinations of 2 to ``max_tokens`` items that at least ``min_count`` blocked
    URLs hold, by FP-growth over (``items``, ``b``: such URLs)."""
    blocked = materialize(rows.where("b > 0 and size(items) > 1").select("items", F.explode(F.sequence(F.lit(1), F.col("b"))).alias("copy")), "url_blocked")
    n, width = blocked.agg(F.count("*"), F.max(F.size("items"))).first()
    if n < min_count:
        return rows.select(F.col("items").alias("rule")).limit(0)

    def frequent(baskets: DataFrame, n: int) -> DataFrame:
        model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n).fit(baskets.select("items"))
        return model.freqItemsets.select(F.sort_array("items").alias("rule"))
    if width <= WIDE:
        return frequent(blocked, n).where(F.size("rule").between(2, max_tokens))
    out = None
    for size in range(2, max_tokens + 1):
        some = materialize(blocked.select(F.explode(F.expr(subsets("items", size))).alias("items")), "url_combinations")
        found = frequent(some, max(1, some.count())).where(F.size("rule") == size)
        out = found if out is None else out.unionByName(found)
    return out


def held_by(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each of the rows (with ``items``) with every rule whose items it has all, by an inverted
    index that holds a rule under the item that fewest rules use."""
    postings = rules.withColumn("item", F.explode("rule"))
    uses = postings.groupBy("item").agg(F.count("*").alias("uses"))
    index = postings.join(uses, "item").groupBy("rule").agg(F.min_by("item", F.struct("uses", "item")).alias("item"))
    return (rows.withColumn("item", F.explode("items")).join(index, "item").where(F.size(F.array_except("rule", "items")) == 0)
            .join(rules.withColumnRenamed("rule", "of_rule"), F.col("rule") == F.col("of_rule")).drop("item", "of_rule"))


def mine(labelled: DataFrame, min_count: int = 25, min_confidence: float = 0.6, max_tokens: int = 3) -> tuple[DataFrame, DataFrame]:
    """((``rule``, ``confidence``, ``support``), (``token``, ``item``)) from (``tokens``, ``bad``): item
    combinations that imply a block, none with another inside, and the tokens that are each item."""
    urls = labelled.groupBy(F.sort_array("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
    urls = materialize(urls.withColumn("key", F.struct(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))), "url_sets")
    # tokens of the same URLs have the same counts and combined keys
    stats = urls.select("n", "b", "key", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.bit_xor("key.a").alias("x"), F.bit_xor("key.b").alias("y"))
    sure = F.col("b") >= F.col("n") * min_confidence
    stats = materialize(stats.where(F.col("b") >= min_count), "url_tokens")
    alone = stats.where(sure)
    rules = alone.select(F.array("token").alias("rule"), (F.col("b") / F.col("n")).alias("confidence"), F.col("b").alias("support"))
    classes = stats.where(~sure).groupBy("n", "b", "x", "y").agg(F.min("token").alias("item"), F.collect_list("token").alias("token"))
    members = materialize(alone.select("token", F.col("token").alias("item")).union(classes.select(F.explode("token").alias("token"), "item")), "url_items")
    # URLs that hold a rule already tell nothing new of it; their other items still count
    mixed = materialize(items_of(urls, members.join(alone.select("token"), "token", "left_anti")).select("items", "n", "b"), "url_mixed")
    found = materialize(combinations(mixed, min_count, max_tokens), "url_frequent")
    counted = held_by(mixed, found).groupBy("rule").agg(F.sum("n").alias("n"), F.sum("b").alias("support"))
    passed = materialize(counted.where(F.col("support") >= F.col("n") * min_confidence)
                         .select("rule", (F.col("support") / F.col("n")).alias("confidence"), "support"), "url_passed")
    for size in range(3, max_tokens + 1):
        parts = F.flatten(F.array(*[F.expr(subsets("rule", k)) for k in range(2, size)]))
        inside = (passed.where(F.size("rule") == size).select(F.col("rule").alias("whole"), F.explode(F.transform(parts, lambda x: F.sort_array(x))).alias("rule"))
                  .join(passed.select("rule"), "rule", "left_semi").select(F.col("whole").alias("rule")).distinct())
        passed = passed.join(inside, "rule", "left_anti")
    return materialize(rules.unionByName(passed), "url_rules"), members


def blocked_by(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """(``url``, ``mined_rule``, ``confidence``) of the distinct ``urls`` (``url``, ``tokens``) that a
    mined rule blocks: the surest rule."""
    used = members.join(rules.select(F.explode("rule").alias("item")).distinct(), "item", "left_semi")
    return (held_by(items_of(urls.withColumn("key", F.col("url")), used), rules)
            .groupBy("url").agg(F.max(F.struct("confidence", "rule")).alias("best"))
            .select("url", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence")))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **mining) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule``.
    A page's label is that of the document with its id; it is bad if toxic or of low quality."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    bad = (labels.select(F.col("doc_id").cast("long").alias("labelled"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
           .where("labelled is not null and bad is not null").groupBy("labelled").agg(F.max("bad").alias("bad")))
    labelled = page.join(bad, F.col("page_id") == F.col("labelled")).where("url is not null").select(tokens(F.col("url")).alias("tokens"), "bad")
    mined, members = mine(labelled, **mining)
    open_urls = (page.where(F.col("url").isNotNull() & listed(host(F.col("url")), path(F.col("url")), rules).isNull())
                 .select("url").distinct().select("url", tokens(F.col("url")).alias("tokens")))
    hits = blocked_by(open_urls, mined, members).withColumnRenamed("url", "hit_url")
    decided = page.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    decided = decided.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    return decided.join(hits, F.col("url") == F.col("hit_url"), "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.when(F.col("mined_rule").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("listed").isNull(), F.array_join("mined_rule", " ")).alias("mined_rule"))
