"""Quality rules with risk-controlled cutoffs.

Per-document counts give a few ratios; a rule rejects a document whose ratio exceeds its
stratum's cutoff.  Cutoffs come from the labelled good documents, all of which certify:
a cutoff's false rejections among them are tested with the exact binomial tail
P(Bin(n, risk) <= k).  Within a stratum and rule the cutoffs are walked from lenient to
strict and the walk stops at the first that fails (fixed-sequence testing); over strata
and rules the level is divided by their number (Bonferroni).  The walk is one over all real
numbers, fixed beforehand: false rejections only grow as the cutoff falls, so a cutoff that
passes has none failing above it, wherever it was proposed (as for Wilks' tolerance limits).
So the ladder of cutoffs tried may be quantiles of the same good documents, and none of
them is spent on proposing.  With probability 1 - ``level`` every rule's false-rejection
rate is at most ``risk`` in every stratum, and all rules together reject at most
``len(RATIOS) * risk`` of the good documents.  A stratum certifies nothing and rejects
nothing below ``labels_needed`` good labels: 286 for four strata at the default risk.

Results for odd input: null and empty texts have no words, fail the base rules and are not
kept; a null stratum is a stratum of its own; labels with null values, or of unknown
documents, are ignored, and a document labelled several times counts as good only if all
its labels say so; equal rows get equal results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.session import materialize

from .common import row_slices

#: The symbols counted, and ASCII white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: Bound of a rule's false-rejection rate in a stratum, and the chance that any rule exceeds it.
RISK, LEVEL = 0.02, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        once, twice = set(), set()
        for t in triples:
            (twice if t in once else once).add(t)
        reach = 0
        for i, t in enumerate(triples):
            if t in twice:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated, lines)


def document_counts(docs: DataFrame, stratum: str) -> DataFrame:
    """``doc_id``, ``stratum`` and the counts of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            rows = [text_counts(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "stratum", *COUNTS])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


#: A rule's ratio; a document is rejected when the ratio exceeds the cutoff.
RATIOS = {
    "symbols": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "long_words": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    from math import exp, lgamma, log, log1p
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def labels_needed(strata: int, risk: float = RISK, level: float = LEVEL) -> int:
    """Good labels of a stratum without which no cutoff passes, not even one that rejects none of them."""
    from math import ceil, log
    return ceil(log(level / (len(RATIOS) * strata)) / log(1 - risk))


def certified_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, ladder: int = 40) -> DataFrame:
    """(``stratum``, ``rule``, ``cutoff``, ``n_good``, ``n_rejected``): the strictest cutoff of
    each stratum and rule that passes; strata and rules without one are absent.  The ladder has
    ``ladder`` steps of equal share from rejecting none to rejecting ``risk`` of the good
    documents; no cutoff beyond can pass, as it has more false rejections than ``risk`` allows."""
    good = (labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
            .where("labelled is not null and quality is not null").groupBy("labelled").agg((F.min("quality") == 1).alias("good")))
    # long form: one row per good document and rule; documents that the base rules fail are not the rules' business
    values = (counts.where(~base_failed()).join(good.where("good"), F.col("doc_id") == F.col("labelled"))
              .select("stratum", F.explode(F.create_map(*[x for r, ratio in RATIOS.items() for x in (F.lit(r), ratio())])).alias("rule", "value")))
    values = materialize(values, "quality_values")
    steps = [1 - risk * i / ladder for i in range(ladder + 1)]
    proposed = (values.groupBy("stratum", "rule")
                .agg(F.count("*").alias("n_good"), F.array_distinct(F.percentile_approx("value", steps, 10000)).alias("cutoffs")))
    proposed = materialize(proposed, "quality_proposed")  # one row a stratum and rule
    # false rejections of each proposed cutoff: a document adds to the counts of its own stratum and rule
    rejected = (values.join(F.broadcast(proposed.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "cutoffs")),
                            F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")) & (F.col("value") > F.array_min("cutoffs")))
                .select("s", "r", F.explode(F.filter("cutoffs", lambda c: c < F.col("value"))).alias("c"))
                .groupBy("s", "r", "c").agg(F.count("*").alias("n")))
    tried = proposed.select("stratum", "rule", "n_good", F.explode("cutoffs").alias("cutoff"))
    held = (tried.join(rejected, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")) & (F.col("cutoff") == F.col("c")), "left")
            .select("stratum", "rule", "cutoff", "n_good", F.coalesce("n", F.lit(0)).alias("n_rejected")))
    tests = F.lit(len(RATIOS)) * F.size(F.collect_set(F.coalesce("stratum", F.lit("\0"))).over(_all_rows()))
    held = held.withColumn("tests", tests)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        passed = None
        for row in group.sort_values("cutoff", ascending=False).itertuples(index=False):
            if binomial_tail(int(row.n_rejected), int(row.n_good), risk) > level / row.tests:
                break
            passed = row
        rows = [] if passed is None else [(passed.stratum, passed.rule, passed.cutoff, passed.n_good, passed.n_rejected)]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"])

    return held.groupBy("stratum", "rule").applyInPandas(walk, "stratum string, rule string, cutoff double, n_good long, n_rejected long")


def _all_rows():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept`` and ``rejected_by`` (rules)."""
    counts = materialize(document_counts(docs, stratum), "quality_counts")
    cutoffs = (certified_cutoffs(counts, labels, risk, level).groupBy(F.col("stratum").alias("s"))
               .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    judged = counts.join(cutoffs, F.col("stratum").eqNullSafe(F.col("s")), "left").withColumn("base_failed", base_failed())
    hits = F.array_compact(F.array(*[F.when(ratio() > F.col("cutoffs")[r], F.lit(r)) for r, ratio in RATIOS.items()]))
    return (judged.withColumn("rejected_by", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(hits))
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
            .select("doc_id", "stratum", *COUNTS, "base_failed", "kept", "rejected_by"))
