"""Exact per-group quantiles, no group held or sorted whole in one task.

Spark's exact ``percentile`` / ``median`` keep every distinct value of a group in one
aggregation buffer, which fails when one key holds a third of the table.  Here:

1. one aggregate gives each group's count and a mergeable sketch (``percentile_approx``: rank
   error at most 1 / ``ACCURACY`` of the count), and with it a bracket around each quantile
   that is sure to hold its two neighbouring order statistics;
2. a second pass over the values counts what lies below a bracket and counts each value
   inside (with map-side combine: a heavy value is one row);
3. only the values inside a bracket, at most 4 / ``ACCURACY`` of the rows and the ties at its
   ends, are sorted; running counts find the order statistics.

Groups of up to ``ACCURACY`` rows are their own bracket.  The result is linearly
interpolated between the order statistics around ``q * (n - 1)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: The sketch's rank error is one part in so many.
ACCURACY = 4000


def narrow_values(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, __v) with null values / keys removed, written once as parquet under
    ``spark.checkpoint.dir`` so the upstream plan runs once for all passes."""
    vals = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    for k in keys:
        vals = vals.where(F.col(k).isNotNull())
    return materialize(vals, "quantile_values")


#: Most groups whose statistics are broadcast to their values.
BROADCAST_GROUPS = 100_000


def join_groups(values: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of ``values`` with its group's row of ``groups`` (one row a group).  Left to itself Spark
    may broadcast the values, whose files are small, or shuffle them to a task a group; here
    the groups are broadcast, unless there are too many, and the values stay spread."""
    groups = materialize(groups, "group_stats")
    few = groups.count() <= BROADCAST_GROUPS
    return values.join(F.broadcast(groups) if few else groups, keys)


def exact_quantiles(df: DataFrame, value: str, qs: list[float], keys: list[str] | None = None,
                    names: list[str] | None = None, narrowed: bool = False) -> DataFrame:
    """One row per group: ``keys`` + one double column per quantile in ``qs``.
    Null values are ignored; rows with a null key are dropped (pandas groupby).
    ``narrowed=True`` means ``df`` already is ``narrow_values(...)`` output."""
    user_keys = list(keys or [])
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    vals = df if narrowed else narrow_values(df, value, user_keys)
    keys = user_keys or ["__g"]
    if not user_keys:
        vals = vals.withColumn("__g", F.lit(0))

    margin = 2.0 / ACCURACY
    ends = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-margin, margin)]
    whole = F.col("__n") <= ACCURACY
    brackets = [F.struct(F.when(whole, F.col("__lo")).otherwise(F.col("__p")[2 * i]).alias("lo"),
                         F.when(whole, F.col("__hi")).otherwise(F.col("__p")[2 * i + 1]).alias("hi")) for i in range(len(qs))]
    bounds = (vals.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                                      F.percentile_approx("__v", ends, ACCURACY).alias("__p"))
              .select(*keys, "__n", F.array(*brackets).alias("__b")))
    # a value within its bracket, null below it; values above are not needed
    places = F.transform("__b", lambda b, i: F.struct(i.alias("i"), (F.col("__v") <= b["hi"]).alias("on"), F.when(F.col("__v") >= b["lo"], F.col("__v")).alias("v")))
    counted = (join_groups(vals, bounds, keys).select(*keys, "__n", F.explode(F.filter(places, lambda x: x["on"])).alias("__x"))
               .groupBy(*keys, "__n", F.col("__x.i").alias("__i"), F.col("__x.v").alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    up_to = Window.partitionBy(*keys, "__i").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("__e", F.sum("__c").over(up_to))

    def at(i, rank):
        return F.max(F.when((F.col("__i") == i) & (F.col("__e") - F.col("__c") <= rank) & (rank < F.col("__e")), F.col("__v")))

    picks = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        picks += [at(i, F.floor(pos)).alias(f"__l{i}"), at(i, F.ceil(pos)).alias(f"__h{i}")]
    found = placed.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)
    cols = []
    for i, (q, name) in enumerate(zip(qs, names)):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        cols.append((F.col(f"__l{i}") + (pos - F.floor(pos)) * (F.col(f"__h{i}") - F.col(f"__l{i}"))).alias(name))
    return found.select(*user_keys, *cols)


def exact_median(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, [0.5], keys, [name])
