"""A mail folder into an archive: scan, parse what has changed, merge, reconcile, publish as one version; then embed.

A run writes nothing that a reader sees before its one manifest, so a run that dies leaves the archive as it was, and of two runs
at once the second is done again on what the first has published. Only files that are new or have another size or time are
parsed, once, into a table below the root that is deleted at the end.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.archive import Archive
from tessera.functions import parsing, text
from tessera.functions.embedding import Model, embedder
from tessera.operators import ingest
from tessera.operators.filters import live
from tessera.sources import readers
from tessera.sources.versions import VersionLog

#: Characters of a body under which it is not embedded by itself.
LEAST_BODY = 100


class Staging:
    """Tables of one run, below the archive's root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _shaped(df: DataFrame, schema: str, made: dict[str, Column]) -> DataFrame:
    """The columns of a schema, from `made` where it has them, else from df, else null."""
    from pyspark.sql.types import StructType

    columns = [made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return df.select(*columns)


def _numbered(rows: DataFrame, after: int) -> Column:
    """New ids: unique and above `after`, without a task that sees all rows."""
    return F.monotonically_increasing_id() + F.lit(after + 1)


def parsed_changes(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Each message of the files that are new or changed, by the first path that holds it, with all its fields."""
    todo = files.join(plan.filter("action <> 'unchanged'").select("path"), "path", "left_semi")
    sent = F.try_to_timestamp("date_sent_raw")
    mail = readers.parse_mail(todo).withColumn("date_sent", sent)
    stamp = F.date_format("date_sent", "yyyy-MM-dd HH:mm:ss")
    made = text.synthetic_message_id(stamp, F.col("from_address"), F.coalesce("subject", F.lit("")), F.col("content_hash"))
    return mail.withColumn("message_id", F.coalesce("message_id", made))


def merged(now: Archive, maildir: str, started: dt.datetime, staging: Staging) -> dict[str, DataFrame]:
    """The archive's tables after a scan of a mail folder."""
    spark, at = now.spark, F.lit(started).cast("timestamp")
    files = readers.maildir(spark, maildir)
    listing = staging.keep(files.drop("content"), "listing")
    plan = staging.keep(ingest.scan_plan(listing, now.sync_state), "plan")
    parsed = staging.keep(parsed_changes(files, plan), "parsed")
    last = now.messages.agg(F.max("id")).first()[0] or 0
    first = parsed.groupBy("message_id").agg(F.min("path").alias("path"))
    staged = parsed.join(first, ["message_id", "path"])
    staged = staging.keep(staged.withColumn("new_id", _numbered(staged, last)), "staged")

    # sync state: what was seen has its new time; what was not parsed keeps its hash
    seen = listing.join(parsed.select("path", "message_id", "content_hash"), "path", "left").alias("s")
    old = now.sync_state.alias("o")
    both = old.join(seen, F.col("o.maildir_full_path") == F.col("s.path"), "full")
    pick = lambda new, was: F.coalesce(F.col(f"s.{new}"), F.col(f"o.{was}"))
    state = both.select(
        pick("path", "maildir_full_path").alias("maildir_full_path"), pick("message_id", "message_id").alias("message_id"),
        F.when(F.col("s.path").isNotNull(), at).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        pick("content_hash", "content_hash").alias("content_hash"), pick("folder", "folder").alias("folder"),
        pick("mtime", "file_mtime_utc").alias("file_mtime_utc"), pick("size", "file_size").alias("file_size"),
    )
    state = staging.keep(_shaped(state, schemas.SYNC_STATE, {}), "state")

    # messages: the first copy seen keeps its folder, a new hash brings new contents, a deleted one comes back
    flags = ingest.upsert_messages(now.messages, staged.select("message_id", "folder", "content_hash"))
    flags = staging.keep(flags, "flags").select("message_id", "is_new", "changed", F.col("folder").alias("_folder"), F.col("content_hash").alias("_hash"), F.col("embed_epoch").alias("_epoch"), "embedded", "deleted")
    fresh = staged.select("message_id", F.struct("*").alias("n"))
    rows = now.messages.withColumn("_known", F.lit(True)).join(fresh, "message_id", "full").join(flags, "message_id")
    back = F.col("_known") & F.col("deleted_at").isNotNull() & ~F.col("deleted")
    renew = F.col("n").isNotNull() & (F.col("is_new") | F.col("changed") | F.coalesce(back, F.lit(False)) | F.col("body_text").isNull())
    contents = ("thread_id", "subject", "from_address", "from_name", "to_addresses", "cc_addresses", "date_sent", "date_sent_raw", "body_text", "body_html", "size_bytes")
    made = {c: F.when(renew, F.col(f"n.{c}")).otherwise(F.col(c)) for c in contents}
    names = F.array_join(F.transform("n.attachments", lambda a: a["filename"]), " ")
    made |= {
        "id": F.when(F.col("is_new"), F.col("n.new_id")).otherwise(F.col("id")), "folder": F.col("_folder"), "content_hash": F.col("_hash"), "embed_epoch": F.col("_epoch"),
        "embedded_at": F.when(F.col("embedded"), F.col("embedded_at")), "deleted_at": F.when(F.col("deleted"), F.col("deleted_at")), "indexed_at": F.when(renew, at).otherwise(F.col("indexed_at")),
        "has_attachments": F.when(renew, F.size("n.attachments") > 0).otherwise(F.col("has_attachments")), "attachment_names": F.when(renew, names).otherwise(F.col("attachment_names")),
    }
    messages = staging.keep(_shaped(rows, schemas.MESSAGES, made), "messages")

    # paths of today, and what is gone
    paths = ingest.repaired_paths(state, at)
    messages = messages.join(paths, "message_id", "left")
    where = F.regexp_extract("path", "^(.*)/([^/]+)$", 1), F.regexp_extract("path", "^(.*)/([^/]+)$", 2)
    seen_n, tracked = listing.count(), now.sync_state.count()
    if not ingest.deletion_vetoed(seen_n, tracked, parsed.filter("message_id is null").count()):
        gone = ingest.to_delete(state, at).withColumn("_gone", F.lit(True))
        messages = messages.join(gone, "message_id", "left")
        state = state.filter(F.col("last_seen_at") >= at)
    else:
        messages = messages.withColumn("_gone", F.lit(None).cast("boolean"))
    deleted = F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))
    held = F.col("path").isNotNull()
    messages = _shaped(messages, schemas.MESSAGES, {"maildir_path": F.when(held, where[0]).otherwise(F.col("maildir_path")), "maildir_filename": F.when(held, where[1]).otherwise(F.col("maildir_filename")), "deleted_at": deleted})
    messages = staging.keep(messages, "messages")

    # what hangs on messages that have changed
    touched = staging.keep(flags.filter("is_new or changed").join(messages.select("message_id", "id"), "message_id").select(F.col("id").alias("message_id"), F.col("message_id").alias("_name")), "touched")
    parts = staged.join(touched, staged.message_id == touched._name).select(touched.message_id, F.explode("attachments").alias("a")).select("message_id", "a.*")
    top = now.attachments.agg(F.max("id")).first()[0] or 0
    parts = _shaped(parts, schemas.ATTACHMENTS, {"id": _numbered(parts, top)})
    attachments = ingest.replace_children(now.attachments, staging.keep(parts, "parts"), touched)
    chunks = now.chunks.join(touched, "message_id", "left_anti")
    vectors = now.chunk_embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return {"messages": messages, "attachments": attachments, "chunks": chunks, "chunk_embeddings": vectors, "sync_state": state}


def _published(spark: SparkSession, root: str, how: Callable[[Archive, Staging], dict[str, DataFrame]]) -> Archive:
    stagings: list[Staging] = []

    def anew(now: Archive) -> dict[str, DataFrame]:
        stagings.append(Staging(spark, root))
        return how(now, stagings[-1])

    try:
        return Archive.change(spark, root, anew)
    finally:
        for s in stagings:
            s.drop()


def ingest_maildir(spark: SparkSession, root: str, maildir: str, started: dt.datetime | None = None) -> Archive:
    """Bring the archive below root up to a mail folder; makes the archive if there is none."""
    if not VersionLog(spark, root).snapshot().number:
        Archive.create(spark, root)
    started = started or dt.datetime.now(dt.UTC)
    return _published(spark, root, lambda now, staging: merged(now, maildir, started, staging))


def embedded(now: Archive, model: Model, staging: Staging, at: dt.datetime) -> dict[str, DataFrame]:
    """The tables after every live message that waits has been cut into chunks and embedded."""
    queue = ingest.unembedded(now.messages, None)
    body = queue.filter(F.char_length(F.trim("body_text")) >= LEAST_BODY).select(F.col("id").alias("message_id"), F.lit(-1).alias("part"), F.lit(None).cast("long").alias("attachment_id"), F.col("body_text").alias("t"))
    parts = now.attachments.filter("extracted_text is not null").join(queue.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    parts = parts.select("message_id", F.col("part_index").alias("part"), F.col("id").alias("attachment_id"), F.concat_ws("\n\n", "filename", "extracted_text").alias("t"))
    cut = body.unionByName(parts).withColumn("pieces", parsing.column(parsing.chunk_text, "array<string>", "t")).select("message_id", "part", "attachment_id", F.posexplode("pieces").alias("k", "chunk_text"))
    number = F.row_number().over(Window.partitionBy("message_id").orderBy("part", "k")) - 1
    last = now.chunks.agg(F.max("id")).first()[0] or 0
    cut = cut.withColumn("chunk_index", number)
    new = staging.keep(_shaped(cut, schemas.CHUNKS, {"id": _numbered(cut, last), "source": F.when(F.col("part") < 0, "body").otherwise("attachment")}), "chunks")
    vectors = new.select("id", F.col("chunk_text").alias("text")).mapInArrow(embedder(model), "id long, embedding array<float>")
    vectors = staging.keep(vectors.select(F.col("id").alias("chunk_id"), "embedding"), "vectors")
    waited = F.col("deleted_at").isNull() & F.col("embedded_at").isNull()
    messages = now.messages.withColumn("embedded_at", F.when(waited, F.lit(at).cast("timestamp")).otherwise(F.col("embedded_at")))
    kept = now.chunks.join(queue.select(F.col("id").alias("message_id")), "message_id", "left_anti")
    held = now.chunk_embeddings.join(kept.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return {"messages": messages, "chunks": kept.unionByName(new), "chunk_embeddings": held.unionByName(vectors)}


def embed_pending(spark: SparkSession, root: str, model: Model, at: dt.datetime | None = None) -> Archive:
    """Embed what waits; messages that change meanwhile make this a conflict and are taken as they then are."""
    return _published(spark, root, lambda now, staging: embedded(now, model, staging, at or dt.datetime.now(dt.UTC)))


def counts(now: Archive) -> DataFrame:
    """One row: live messages, deleted ones, files, chunks."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(live(now.messages), "messages").join(one(now.messages.filter("deleted_at is not null"), "deleted")).join(one(now.sync_state, "files")).join(one(now.chunks, "chunks"))
