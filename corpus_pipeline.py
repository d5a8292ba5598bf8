"""Corpus pipeline: language, lines, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.  ``run`` applies them to the table, each
stage's rows written as Parquet to the shared checkpoint folder and read again.

Null or letterless texts are rejected by the first stage; a line dropped by the second
leaves the rest of its text, maybe empty; equal rows are one group of the third; extra
columns pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm import byte_bpe, decontam, langid, line_dedup, simhash
from voltaic.llm.common import read_table
from voltaic.llm.queries import MULTI_BPE, bpe_pattern, vocabulary
from voltaic.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.accepted(docs, langid.train(langid.training_docs(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that at least five of them share."""
    rows = line_dedup.deduplicate_lines(docs)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.representatives(docs, shingle_words=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids``, ``ids_sha256``, ``decoded_sha256``) of each document."""
    ranks = vocabulary(MULTI_BPE)
    rows = byte_bpe.decode(byte_bpe.encode(docs, ranks, bpe_pattern()), ranks)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("encode", encode)]

#: The stages before the last need edit distances, clusters and fingerprints: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
