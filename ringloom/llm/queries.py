"""Registered queries of the corpus operators and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm.common import ship, table
from ringloom.llm.decontaminate import contained, contained_sql
from ringloom.llm.kd_shards import kd_shards
from ringloom.llm.language_id import language_model, predicted
from ringloom.llm.license_scan import license_digest, license_sql
from ringloom.llm.lm_score import lm_scores
from ringloom.llm.minhash_dedup import near_duplicates
from ringloom.llm.packing import packed
from ringloom.llm.pivot_dedup import pivot_duplicates
from ringloom.llm.preference_format import neighbours, neighbours_sql
from ringloom.llm.toxicity import scored, toxicity_model

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(ship(spark), sf_dir, "documents"))


def op2_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_duplicates(table(ship(spark), sf_dir, "embeddings"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(ship(spark), sf_dir, "documents"), remainder(7) != 2)
    cols = "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    return out.select("doc_id", held_out(7, 2), *cols)


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(ship(spark), sf_dir, "documents"), levels=4)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(ship(spark), sf_dir, "documents"), k=2)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(ship(spark), sf_dir, "documents"), tokenizer_path())


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def held_out(n: int, r: int) -> Column:
    """Whether the remainder is r; a row without a doc_id has none."""
    return F.coalesce(remainder(n) == r, F.lit(False)).alias("held_out")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    model = language_model(docs.where(remainder(3) != 1))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(3, 1), "lang_pred", "score")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(ship(spark), sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_license_scan, op2_pivot_dedup, op3_lm_score, op4_kd_shards, op5_toxicity, op6_minhash_dedup, op7_decontaminate, op8_pattern_packing, op9_language_id, op10_preference_format)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op7_decontaminate": contained_sql(), "op10_preference_format": neighbours_sql()}
