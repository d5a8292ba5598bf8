"""The registered queries of the subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.session import intermediate_path

from . import byte_bpe, decontam, langid, licences, line_dedup, phrases, quality, simhash, suffix_dedup, token_orc, topk_search, url_rules, whitening
from .common import read_table

#: Fixed values: (host, path, verdict) of the listed URL rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
WORD_BPE = "word_bpe_49k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = intermediate_path(spark, "token_orc")
    token_orc.write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary(WORD_BPE))
    return token_orc.token_digests(spark, path)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read_table(spark, sf_dir, "documents"))
    return found.withColumn("notice_ids", F.array_join("notice_ids", ","))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("rejected_by", ",").alias("rejected_by"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), URL_RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary(MULTI_BPE)
    encoded = byte_bpe.encode(read_table(spark, sf_dir, "documents"), ranks, bpe_pattern())
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(langid.training_docs(docs))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(read_table(spark, sf_dir, "embeddings"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_orc, op2_licences, op3_simhash, op4_suffix_dedup, op5_quality, op6_url_rules, op7_line_dedup,
                            op8_byte_bpe, op9_decontamination, op10_langid, op11_phrases, op12_whitening, op13_topk_search)
}

OP7_SQL = """
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select rid, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as last_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, r.key is not null and k.doc_id <> r.last_doc as gone from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by rid, doc_id
"""

ORACLES = {"op2_licences": licences.oracle(), "op7_line_dedup": OP7_SQL, "op11_phrases": phrases.oracle(), "op13_topk_search": topk_search.oracle()}
