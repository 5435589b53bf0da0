"""Hybrid search: reciprocal rank fusion of the keyword and the vector leg."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import keyword, vectors

RRF_K, LEG, SNIPPET = 60, 50, 240


def fuse(kw: DataFrame, vec: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """kw (id, kw_rank), vec (id, vec_rank) -> (id, kw_rank, vec_rank, score); ties by keyword rank, then vector rank."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = kw.join(vec, "id", "full").withColumn("score", F.round(part("kw_rank") + part("vec_rank"), 12))
    return both.orderBy(F.col("score").desc(), F.col("kw_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last(), "id").limit(limit)


def hybrid_search(messages: DataFrame | None, live_messages: DataFrame, chunks: DataFrame, text: str, query: DataFrame, limit: int = 20, index=None, analyser: str = "plain") -> DataFrame:
    """(id, kw_rank, vec_rank, chunk_id, score)."""
    kw = vectors.ranked(keyword.search(messages, text, LEG, live_messages, index, analyser), ["score", "id"], "kw_rank").select("id", "kw_rank")
    near = vectors.semantic_search(chunks, live_messages, query, LEG)
    vec = vectors.ranked(near, ["distance", "chunk_id"], "vec_rank").select(F.col("message_id").alias("id"), "vec_rank", "chunk_id")
    return fuse(kw, vec, limit).select("id", "kw_rank", "vec_rank", "chunk_id", "score")
