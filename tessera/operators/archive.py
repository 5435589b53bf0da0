"""Lookups, browsing, threads, folders and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import live

#: Limits of one thread reply.
THREAD_MESSAGES, THREAD_CHARS = 100, 200_000


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def message_with_attachments(messages: DataFrame, attachments: DataFrame, key: str, value) -> DataFrame:
    """One message with its attachments, in order of their part; only its own are grouped."""
    found = messages.filter(F.col(key) == value)
    own = attachments.join(F.broadcast(found.select(F.col("id").alias("_m"))), F.col("message_id") == F.col("_m"))
    parts = own.groupBy("_m").agg(F.sort_array(F.collect_list(F.struct("part_index", "filename"))).alias("parts"))
    return found.join(parts, F.col("id") == F.col("_m"), "left").drop("_m")


def attachments_of(attachments: DataFrame, message: int) -> DataFrame:
    return attachments.filter(F.col("message_id") == message).withColumn("indexed", F.coalesce(F.col("extraction_status").isin("done", "ocr"), F.lit(False))).orderBy("part_index")


def attachment_summaries(attachments: DataFrame) -> DataFrame:
    return attachments.select("id", "message_id", "part_index", "filename", "extraction_status", F.char_length("extracted_text").cast("long").alias("text_chars"))


def browse(messages: DataFrame, limit: int) -> DataFrame:
    """Live messages, latest first, undated last."""
    return live(messages).orderBy(F.col("date_sent").desc_nulls_last(), "id").limit(limit)


def thread_of(messages: DataFrame, message: int) -> DataFrame:
    """The live thread of a message, oldest first, undated last; a message without thread alone."""
    seed = messages.filter(F.col("id") == message).select(F.col("id").alias("_id"), F.col("thread_id").alias("_t"))
    same = (F.col("thread_id") == F.col("_t")) | (F.col("_t").isNull() & (F.col("id") == F.col("_id")))
    return live(messages).join(F.broadcast(seed), same).drop("_id", "_t").orderBy(F.col("date_sent").asc_nulls_last(), "id")


def body_budget(messages: DataFrame, key: str, order: list[Column], max_messages: int = THREAD_MESSAGES, max_chars: int = THREAD_CHARS) -> DataFrame:
    """The first messages of each thread with their bodies cut to what is left of the thread's budget.

    The first are told before threads are gathered, so a thread of any length sends max_messages rows from each task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    first = messages.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= max_messages)
    before = F.coalesce(F.sum(F.char_length("body_text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = first.withColumn("left", F.greatest(F.lit(0).cast("long"), F.lit(max_chars) - before))
    return ranked.withColumn("body", F.substring("body_text", F.lit(1), F.col("left").cast("int")))


def membership(messages: DataFrame, sync_state: DataFrame, *carried: str) -> DataFrame:
    """(id, folder, carried) of live messages: their own folder and those of their copies."""
    rows = live(messages)
    copies = sync_state.filter("folder is not null").select(F.col("message_id").alias("_h"), F.col("folder").alias("f"))
    others = rows.join(copies, F.col("message_id") == F.col("_h")).filter(~F.col("f").eqNullSafe(F.col("folder")))
    return rows.select("id", "folder", *carried).union(others.select("id", "f", *carried).distinct())


def folder_stats(messages: DataFrame, sync_state: DataFrame) -> DataFrame:
    rows = membership(messages, sync_state, "date_sent")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n_messages"), F.min("date_sent").alias("oldest"), F.max("date_sent").alias("latest"))


def empty_hint(messages: DataFrame, configured: bool, where: str) -> DataFrame:
    """(n_messages, hint): why an archive without any messages may be empty, null where it has some."""
    why = (
        f"The archive at {where} holds no messages. It is set up, but nothing has been ingested yet, or this is not its place: look at the status and the mail folder."
        if configured
        else f"The archive at {where} holds no messages and was never set up here: run the installation, then ingest a mail folder."
    )
    return messages.agg(F.count(F.lit(1)).alias("n_messages")).withColumn("hint", F.when(F.col("n_messages") == 0, why))


def archive_stats(messages: DataFrame) -> DataFrame:
    return live(messages).agg(F.count(F.lit(1)).alias("n_messages"), F.min("date_sent").alias("oldest"), F.max("date_sent").alias("latest"), F.min_by("id", F.struct("date_sent", "id")).alias("oldest_id"), F.max_by("id", F.struct("date_sent", "id")).alias("latest_id"))


def pipeline_counts(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    m = messages.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("deleted_at").isNull() & F.col("embedded_at").isNotNull()).alias("embedded"),
        F.count_if(F.col("deleted_at").isNull() & F.col("embedded_at").isNull()).alias("unembedded"), F.max("indexed_at").alias("last_indexed"),
    )
    return m.join(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def coverage(messages: DataFrame) -> DataFrame:
    c = live(messages).agg(F.count(F.lit(1)).alias("live"), F.count("embedded_at").alias("embedded"))
    return c.select("live", "embedded", F.when(F.col("live") > 0, F.round(F.col("embedded") * 100.0 / F.col("live"), 1)).otherwise(0.0).cast("double").alias("pct"), F.greatest(F.col("live") - F.col("embedded"), F.lit(0)).alias("backlog"))


def rollup_text(attachments: DataFrame) -> DataFrame:
    """Names and texts of each message's attachments, joined by a space in order of their part."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("part_index", F.col(c).alias("v"))))), lambda x: x["v"]), " ")
    return attachments.groupBy("message_id").agg(joined("filename").alias("attachment_names"), joined("extracted_text").alias("attachment_text"))


def rollups(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts of attachments by folder, by status, by engine, by folder and month, and of all, in one pass over one join.

    sets tells which of the columns a row is grouped by: bit by bit 0, from the left, where it is.
    """
    of = messages.filter("deleted_at is null").select(F.col("id").alias("message_id"), "folder", F.date_format("date_sent", "yyyy-MM").alias("month"))
    rows = attachments.join(of, "message_id").select("message_id", "folder", F.coalesce("extraction_status", F.lit("pending")).alias("status"), F.coalesce("ocr_model", F.lit("none")).alias("engine"), "month", "size_bytes")
    keys = ["folder", "status", "engine", "month"]
    sets = [[F.col(k) for k in some] for some in (["folder"], ["status"], ["engine"], ["folder", "month"], [])]
    counts = [F.count(F.lit(1)).alias("attachments"), F.count_distinct("message_id").alias("messages"), F.sum("size_bytes").alias("bytes")]
    return rows.groupingSets(sets, *keys).agg(F.grouping_id().cast("long").alias("sets"), *counts)
