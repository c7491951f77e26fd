"""Cleaning pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality classifier: documents whose score is below the cut go;
2. line dedup: later occurrences of fuzzy-equal lines go, and documents that thereby lose every line;
3. MinHash near-dedup (five words, similarity 0.8): the smallest id of each component stays;
4. benchmark decontamination: documents that cover half of an item or more go;
5. best-fit packing of what is left into sequences of at most 1024 tokens.

All stages but the last return the columns of their input, whatever other names it has.  Stages 2 to 4 remove
rows by id and hash of the text, so rows that share an id but not a text are judged each for itself, and rows
equal in both stay or go together.  Rows with a null id pass these stages untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import common, decontaminate, line_dedup, near_dedup, packing, quality
from lexigrain.llm.queries import QUALITY_CUT


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows that are not named, by id and hash of the text, in ``gone(doc_id, tkey)``."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    named = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    left = named.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("tkey")), "left_anti")
    return left.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score reaches the cut; the text is scored in place, without a shuffle."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, QUALITY_CUT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.rewrite(docs, line_dedup.removed(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, common.stage(near_dedup.copies(docs, k=5), "copies"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_rows(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, common.stage(found.select("doc_id", "tkey"), "leaks"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Boosting, fuzzy lines and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the packed pieces."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
