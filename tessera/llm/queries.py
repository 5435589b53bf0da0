"""The contract queries: each reads its whole table, calls its operator with production parameters and keeps the digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lexical, line_dedup, minmax_dedup, mixing, periodic, substring_dedup, urlfilter, warc
from tessera.llm.scratch import Scratch
from tessera.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import benchmark_leaks

    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tiles")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("error")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(_table(spark, sf_dir, "documents")).drop("spans")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import audio

    scratch = Scratch(spark, "media")
    media = audio.store_media(_table(spark, sf_dir, "documents"), scratch)
    stored = audio.store_tensors(media, scratch)
    scratch.drop(media)
    out = audio.media_features(stored).withColumnRenamed("id", "doc_id")
    return out.withColumn("feature", audio.feature_text(F.col("mel_mean"), F.col("n_frames"), F.col("segments"))).drop("n_frames", "mel_mean", "segments")


def op8_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"), ngram=3, percent=85)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.with_periods(_table(spark, sf_dir, "documents")), min_exp=4, min_len=6)
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    digests = [periodic.digest_runs(F.col("runs")).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256")]
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, *digests)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii

    out = pii.personal_data(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("spans"), k.name).alias(f"n_{k.name}") for k in pii.BASE]
    base = F.sha2(pii.joined(F.filter("spans", lambda s: s["base"])), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_audio_features": op7_audio_features,
    "op8_minmax_near_dup": op8_minmax_near_dup,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_url_filter": urlfilter.ORACLE,
    "op8_minmax_near_dup": minmax_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_ranked_search": lexical.ORACLE,
    "op12_periodic_runs": periodic.ORACLE,
}
