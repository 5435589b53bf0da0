"""Incremental maintenance: scans, upserts, reconciliation, embedding queues. All copy-on-write joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN_BATCH = 1000


def merge_by_key(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows replace current ones of their key."""
    return current.join(staged.select(key), key, "left_anti").unionByName(staged)


def upsert_messages(current: DataFrame, staged: DataFrame) -> DataFrame:
    """(message_id, is_new, changed, requeue, folder, content_hash, embed_epoch, embedded, deleted) after staging.

    The first copy seen keeps its folder, unless it was deleted: then the new copy brings the message back. A missing
    prior hash counts as unchanged. A change clears the embedding and raises the epoch.
    """
    c, s = current.alias("c"), staged.alias("s")
    both = c.join(s, F.col("c.message_id") == F.col("s.message_id"), "full")
    new, seen = F.col("c.message_id").isNull(), F.col("s.message_id").isNotNull()
    back = seen & ~new & F.col("c.deleted_at").isNotNull()
    owner = back | (F.col("s.folder") == F.col("c.folder"))
    changed = seen & ~new & owner & F.col("c.content_hash").isNotNull() & (F.col("c.content_hash") != F.col("s.content_hash"))
    requeue = F.coalesce(changed, F.lit(False))
    return both.select(
        F.coalesce("c.message_id", "s.message_id").alias("message_id"), new.alias("is_new"), requeue.alias("changed"),
        F.when(new | back, F.col("s.folder")).otherwise(F.col("c.folder")).alias("folder"),
        F.when(new | (seen & F.coalesce(owner, F.lit(False))), F.col("s.content_hash")).otherwise(F.col("c.content_hash")).alias("content_hash"),
        F.when(new, 0).when(requeue, F.col("c.embed_epoch") + 1).otherwise(F.col("c.embed_epoch")).cast("long").alias("embed_epoch"),
        (F.col("c.embedded_at").isNotNull() & ~requeue).alias("embedded"), (F.col("c.deleted_at").isNotNull() & ~seen).alias("deleted"),
    )


def replace_children(current: DataFrame, staged: DataFrame, changed_ids: DataFrame, key: str = "message_id") -> DataFrame:
    """Children of changed parents are replaced whole."""
    ids = changed_ids.select(key).distinct()
    return current.join(ids, key, "left_anti").unionByName(staged.join(ids, key, "left_semi"))


def add_missing(current: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Only the staged rows whose key is not there yet."""
    return staged.join(current.select(*keys), keys, "left_anti")


def scan_plan(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action): new, unchanged or reparse, by size and time; without a stored time by when it was last seen."""
    l, s = listing.alias("l"), state.alias("s")
    same = (F.col("s.file_mtime_utc") == F.col("l.mtime")) & (F.col("s.file_size") == F.col("l.size"))
    legacy = F.col("s.file_mtime_utc").isNull() & (F.col("l.mtime") <= F.col("s.last_seen_at"))
    fast = F.col("s.content_hash").isNotNull() & (same | legacy)
    return l.join(s, F.col("l.path") == F.col("s.maildir_full_path"), "left").select(F.col("l.path").alias("path"), F.when(F.col("s.maildir_full_path").isNull(), "new").when(fast, "unchanged").otherwise("reparse").alias("action"))


def upsert_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """State by path after a scan: what was seen has its new time, and the old hash where none was computed."""
    a, b = state.alias("a"), seen.alias("b")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.maildir_full_path") == F.col("b.maildir_full_path"), "full").select(*(pick(c) for c in ("maildir_full_path", "message_id", "folder", "last_seen_at", "content_hash")))


def to_delete(state: DataFrame, started: Column) -> DataFrame:
    """Message ids of which no copy was seen since the scan started."""
    stale = state.filter(F.col("last_seen_at") < started).select("message_id").distinct()
    return stale.join(state.filter(F.col("last_seen_at") >= started).select("message_id"), "message_id", "left_anti")


def deletion_vetoed(seen: int, tracked: int, failures: int) -> bool:
    """A scan with failures, or one that saw nothing of an archive that has files, deletes nothing."""
    return failures > 0 or (seen == 0 and tracked > 0)


def vetoed(seen: Column, tracked: Column, failures: Column) -> Column:
    """deletion_vetoed() of columns."""
    return (failures > 0) | ((seen == 0) & (tracked > 0))


def repaired_paths(state: DataFrame, started: Column) -> DataFrame:
    """(message_id, path): the latest fresh copy."""
    return state.filter(F.col("last_seen_at") >= started).groupBy("message_id").agg(F.max_by("maildir_full_path", F.struct("last_seen_at", "maildir_full_path")).alias("path"))


def purge(messages: DataFrame, children: dict[str, tuple[DataFrame, str]], cutoff: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Messages deleted up to the cutoff go, and what hangs on them; children: name -> (table, its message column)."""
    gone = messages.filter(F.col("deleted_at") <= cutoff).select(F.col("id").alias("_gone"))
    keep = lambda df, c: df.join(gone, F.col(c) == F.col("_gone"), "left_anti")
    return keep(messages, "id"), {n: keep(df, c) for n, (df, c) in children.items()}


def unembedded(messages: DataFrame, batch: int | None, exclude: list[int] = ()) -> DataFrame:
    """The queue, oldest id first: the next `batch`, or all of it in no order."""
    rows = messages.filter("deleted_at is null and embedded_at is null")
    rows = rows.filter(~F.col("id").isin(*exclude)) if exclude else rows
    return rows if batch is None else rows.orderBy("id").limit(batch)


def guarded(staged: DataFrame, current: DataFrame) -> DataFrame:
    """Staged results whose message has still the hash and epoch they were made from."""
    c = current.select("id", F.col("content_hash").alias("_h"), F.col("embed_epoch").alias("_e"))
    return staged.join(c, "id").filter(F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("embed_epoch").eqNullSafe(F.col("_e"))).drop("_h", "_e")


def requeue(messages: DataFrame, which: Column) -> DataFrame:
    """The embedding is cleared and the epoch raised together."""
    hit = F.coalesce(which, F.lit(False))
    return messages.withColumn("embed_epoch", F.col("embed_epoch") + hit.cast("long")).withColumn("embedded_at", F.when(~hit, F.col("embedded_at")))


def orphans(embeddings: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    return embeddings.join(owners.select(F.col(owner_key).alias("_o")), F.col(key) == F.col("_o"), "left_anti")


def released(quarantine: DataFrame, current: DataFrame) -> DataFrame:
    """Quarantined messages that have changed since, or are gone."""
    c = current.select(F.col("id").alias("_id"), F.col("content_hash").alias("_h"), F.col("embed_epoch").alias("_e"))
    same = F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("embed_epoch").eqNullSafe(F.col("_e"))
    return quarantine.join(c, F.col("id") == F.col("_id"), "left").filter(F.col("_id").isNull() | ~same).drop("_id", "_h", "_e")


def switch_model(messages: DataFrame, identity: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Everything is to be embedded anew under another identity; vectors and chunks are dropped by the caller."""
    return requeue(messages, F.col("embedded_at").isNotNull()), identity


def space_conflict(stored: dict[str, str | None], wanted: dict[str, str]) -> str | None:
    """Why vectors must not be read: a drift marker, or what differs. Absent values pass."""
    if stored.get("drift"):
        return "drift"
    return next((k for k, v in wanted.items() if stored.get(k) not in (None, v)), None)


def space_conflicts(drift: Column, stored: dict[str, Column], wanted: dict[str, str]) -> Column:
    """space_conflict() of columns."""
    out = F.when(F.coalesce(drift, F.lit("")) != "", F.lit("drift"))
    for key, value in wanted.items():
        out = out.when(stored[key].isNotNull() & (stored[key] != value), F.lit(key))
    return out


def apply_values(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value) after changes (key, value, at): the latest of a key counts, and a null value deletes it."""
    last = changes.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return current.join(last.select("key"), "key", "left_anti").unionByName(last.filter("value is not null"))
