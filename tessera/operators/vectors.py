"""Exact nearest neighbours and the upkeep of vectors, with array functions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_EPSILON, SENTINEL_COSINE, AUDIT_LOW, AUDIT_HIGH = 1e-3, 0.999, 0.5, 1.5
HORIZON = 4096


def doubles(c: str | Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def norm(c: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(c), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 for different widths or a zero vector."""
    dot = _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))
    bottom = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (bottom == 0), 0.0).otherwise(dot / bottom)


def normalized(c: Column) -> Column:
    """Unit length, but for zero vectors and those that have it nearly."""
    n = norm(c)
    return F.when((n == 0) | (F.abs(n - 1) <= UNIT_EPSILON), doubles(c)).otherwise(F.transform(doubles(c), lambda x: x / n))


def vector_state(c: Column, width: int) -> Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNull(), "missing").when(F.size(c) != width, "width").when(bad, "not finite").otherwise("ok")


def audit_class(c: Column) -> Column:
    bad = F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    n = norm(c)
    return F.when(bad, "not_finite").when(n == 0, "zero").when(n < AUDIT_LOW, "low_norm").when(n > AUDIT_HIGH, "high_norm").otherwise("ok")


def with_distance(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """query has one row with a vector `q`: its size is that of a vector, so it is broadcast."""
    return chunks.join(F.broadcast(query.select("q"))).withColumn("distance", F.round(l2(F.col("embedding"), F.col("q")), 6)).drop("q")


def knn(chunks: DataFrame, query: DataFrame, k: int) -> DataFrame:
    return with_distance(chunks, query).select("id", "distance").orderBy("distance", "id").limit(k)


def best_chunks(scored: DataFrame) -> DataFrame:
    """The nearest chunk of each message, folded with a partial aggregate rather than a window over all chunks."""
    return scored.groupBy("message_id").agg(F.min(F.struct("distance", F.col("id").alias("chunk_id"))).alias("b")).select("message_id", "b.chunk_id", "b.distance")


def semantic_search(chunks: DataFrame, messages: DataFrame, query: DataFrame, limit: int, attachments: DataFrame | None = None, horizon: int | None = None) -> DataFrame:
    """(message_id, chunk_id, distance[, attachment]) of the nearest messages among `messages`.

    Filters come first and the search is exact; with a horizon only that many nearest chunks are looked at before them.
    """
    scored = with_distance(chunks, query)
    if horizon:
        scored = scored.orderBy("distance", "id").limit(horizon)
    scored = scored.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    best = best_chunks(scored).orderBy("distance", "chunk_id").limit(limit)
    if attachments is None:
        return best
    of = chunks.select(F.col("id").alias("chunk_id"), "attachment_id")
    names = attachments.select(F.col("id").alias("attachment_id"), F.col("filename").alias("attachment"))
    return best.join(of, "chunk_id").join(names, "attachment_id", "left").select("message_id", "chunk_id", "distance", "attachment")


def ranked(hits: DataFrame, order: list, name: str) -> DataFrame:
    """Ranks of a result already cut to its limit."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(message_id, chunks); their sum bounds what a nearest-neighbour search can return."""
    return chunks.groupBy("message_id").agg(F.count(F.lit(1)).alias("chunks"))


def input_text(text: Column, prefix: str, suffix: str) -> Column:
    """What a model is sent for a text; queries and documents have a prefix and suffix each of their own."""
    return F.concat(F.lit(prefix), text, F.lit(suffix))
