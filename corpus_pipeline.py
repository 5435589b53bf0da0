"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

toxicity drops documents the classifier marks, line dedup rewrites texts, MinHash near-dedup keeps one document of each
component, also of rows with null or repeated ids, decontamination drops documents that leak a benchmark item, mixing repeats documents to target weights.
All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import drop_leaking
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minmax_dedup import near_duplicates
from tessera.llm.mixing import emit, mix_sources
from tessera.llm.scratch import Scratch
from tessera.llm.toxicity import score_toxicity
from tessera.session import spread


def _side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, _side(spark, sf_dir, "labels"), carry=True)
    return scored.filter("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text")), "n_chars": F.char_length("kept_text")}
    kinds = dict(docs.dtypes)
    return out.select(*(F.coalesce(new[c], F.col(f"row.{c}")).cast(kinds[c]).alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least doc_id stays; nulls come last, and rows with one id go by their text's hash.

    Where ids are null or repeat each row is judged by itself, under a number in that order.
    """
    key, columns = "doc_id", docs.columns
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        key, number = "_row", F.monotonically_increasing_id()
        ordered = docs.withColumn("_at", number).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "_at")
        docs = Scratch(spark, "rows").keep(ordered.select(*columns, number.alias("_row")), "rows")
    gone = near_duplicates(docs, key, ngram=5, percent=80).filter("not kept").select(key).distinct()
    return docs.join(gone, key, "left_anti").select(columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, _side(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return emit(mix_sources(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: A trained classifier, min-max hashing and tiling have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spread(_side(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
