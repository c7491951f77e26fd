"""The thin queries over the operators; each runs over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, langid, line_dedup, near_dedup, packing, ppm, quality, records, suffixes, topk

#: Share of label 1 from which a document counts as good.
QUALITY_CUT = 0.3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", F.coalesce(common.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.apply(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(common.fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    manifest = records.write(docs, public_tokenizers.path("word_bpe_49k.json"), common.new_dir(spark, "records"))
    return records.digests(records.read(manifest))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_line_dedup, op3_language_id, op4_exact_topk, op5_best_fit_packing, op6_quality_gam, op7_ppm_scores, op8_suffix_dedup, op9_decontamination, op10_token_records)}
