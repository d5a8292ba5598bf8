"""Sort / limit / top-k (T1-T5) and the semi join on a top-k set.

Top-k after an aggregate is a limit over the (small) aggregate output: Spark
plans it as TakeOrderedAndProject, i.e. per-partition top-k then a merge, so no
global sort of the input is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .stats import category_counts


def top_categories(df: DataFrame, col: str, k: int = 5, min_count: int | None = None) -> DataFrame:
    """The ``k`` most frequent values (ties by name), optionally only
    those with at least ``min_count`` rows."""
    counts = category_counts(df, col)
    if min_count is not None:
        counts = counts.where(F.col("count") >= min_count)
    return counts.orderBy(F.desc("count"), F.asc(col)).limit(k)


def head_and_tail(df: DataFrame, metric: str, name: str, k: int = 15) -> DataFrame:
    """The ``k`` highest and ``k`` lowest rows by ``metric`` with their ``side``
    and ``rank`` (1 = most extreme; a row may appear on both sides when there are fewer
    than 2k rows).  Both sides read one written copy; ranks are set among k rows."""
    df = materialize(df, "head_and_tail")
    sides = []
    for side, order in (("top", F.desc(metric)), ("bottom", F.asc(metric))):
        ranked = F.row_number().over(Window.orderBy(order, F.asc(name)))
        sides.append(df.orderBy(order, F.asc(name)).limit(k).withColumn("side", F.lit(side)).withColumn("rank", ranked))
    return sides[0].unionByName(sides[1])


def chart_set(df: DataFrame, metric: str, name: str, k: int = 10) -> DataFrame:
    """T3, chart order: the ``k`` highest and ``k`` lowest rows, each side reversed (the most
    extreme bar is drawn last); ``place`` is the bar's position."""
    return head_and_tail(df, metric, name, k).withColumn(
        "place", F.count("*").over(Window.partitionBy("side")) - F.col("rank") + 1)


def sorted_by(df: DataFrame, cols: list, k: int | None = None) -> DataFrame:
    """T4 / T5: order by explicit keys, optionally the first ``k`` rows."""
    out = df.orderBy(*cols)
    return out.limit(k) if k is not None else out


def semi_join_top(df: DataFrame, col: str, k: int = 5, min_count: int = 3) -> DataFrame:
    """Rows whose ``col`` is one of the top-k supported values.  The top set
    has at most ``k`` rows, so the semi join is broadcast by construction."""
    top = top_categories(df, col, k, min_count).select(col)
    return df.join(F.broadcast(top), col, "left_semi")
