"""Corpus preparation in five stages over the documents table.

Each stage takes all that the one before it kept and returns rows with the
columns of documents; the last returns the packed pieces.

language   documents without a letter go, and those whose language is predicted with less than
           LEAST_SURE: the best language's regression value is nearer to that of the other
           languages' texts (-1) than to none at all, however many languages there are
toxicity   documents that score TOXIC or more go
near       one document of each group of near copies stays (five-word shingles, 0.8)
benchmark  documents that hold a benchmark item go (five-word shingles, 0.8)
pack       tokenised and packed into sequences of at most 2048 ids

Where a stage drops rows it judges each row alone, but for near, which keeps
the smallest doc_id of a group. Rows of one doc_id stay or go together at near and benchmark; rows
without a doc_id cannot be named there and stay. An empty input passes through all
stages as empty. Columns that documents has besides its own go through unchanged, whatever their names.
"""

from __future__ import annotations

import atexit
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm.common import dropped, free_name, shared_dir, ship, table, without
from ringloom.llm.decontaminate import contained
from ringloom.llm.language_id import UNKNOWN, language_model, prediction
from ringloom.llm.minhash_dedup import near_duplicates
from ringloom.llm.packing import packed
from ringloom.llm.queries import remainder, tokenizer_path
from ringloom.llm.toxicity import toxic_score, toxicity_model

LEAST_SURE, TOXIC = 0.12, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = language_model(docs.where(remainder(3) != 1))
    own = free_name(docs, "prediction")
    out = docs.withColumn(own, prediction(model))
    return out.where((F.col(own)["lang"] != UNKNOWN) & (F.col(own)["score"] >= LEAST_SURE)).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity_model(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    own = free_name(docs, "toxicity")
    return docs.withColumn(own, toxic_score(model)).where(F.col(own) < TOXIC).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return without(docs, near_duplicates(docs, k=5).where("not kept"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = contained(docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null")
    return without(docs, found.select("doc_id").distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer_path())


STAGES = [("language", language), ("toxicity", toxicity), ("near", near), ("benchmark", benchmark), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet into the shared folder and read again. A stage's
    table goes when the next one is written, the last one with the session."""
    docs = table(ship(spark), sf_dir, "documents")
    base = f"{shared_dir(spark)}/ringloom/pipeline-{uuid4().hex}"
    atexit.register(dropped, spark, base)

    def step(at: tuple[DataFrame, str | None], stage: tuple) -> tuple[DataFrame, str]:
        (df, before), (name, f), path = at, stage, f"{base}/{stage[0]}"
        f(spark, df, sf_dir).write.parquet(path)
        if before:
            dropped(spark, before)
        return spark.read.parquet(path), path

    return reduce(step, STAGES, (docs, None))[0]
