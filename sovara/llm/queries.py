"""The registered queries of this subpackage: thin calls of the operators over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sovara.llm import bpe, embeddings, jaccard, language, merkle, packing, passages, quality, rules, toxicity, urls, whitening, wordtable
from sovara.llm.common import fold, read_table

#: (host, path, verdict): the rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), lambda i: fold(i, 3) != 1)
    return quality.score(docs, model).selectExpr("doc_id", "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 as held_out", "score", "predicted")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = language.fit(docs, lambda i: fold(i, 5) != 0)
    return language.predict(docs, net).selectExpr("doc_id", "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 as held_out", "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(read_table(spark, sf_dir, "documents")), rules.POLICIES["default"])
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), lambda i: fold(i, 5) != 0)
    return toxicity.score(docs, model).selectExpr("doc_id", "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 as held_out", "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(read_table(spark, sf_dir, "documents"))


def op11_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return merkle.verify(merkle.manifest(docs, merkle.lower_third(docs)))


def queries() -> dict:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from sovara.llm.oracle import SQL

    return dict(SQL)
