"""Liveness, backlog and failure states, and what is read from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_BEATS, STUCK_FAILURES, STUCK_SECONDS, STALL_SECONDS, SYNC_FLOOR, SYNC_INTERVALS = 3, 2, 600, 1800, 1800, 4


def liveness(age: Column, interval: Column) -> Column:
    """A beat older than three intervals is stale; no beat is unknown."""
    return F.when(age.isNull() | interval.isNull(), "unknown").when(age > STALE_BEATS * interval, "stale").otherwise("alive")


def sync_window(interval: Column) -> Column:
    return F.greatest(SYNC_INTERVALS * interval, F.lit(SYNC_FLOOR))


def stuck(failures: Column, backlog: Column, last_failed: Column, age: Column) -> Column:
    return (failures >= STUCK_FAILURES) | ((backlog > 0) & last_failed & (age >= STUCK_SECONDS))


def ocr_stalled(enabled: Column, pending: Column, age: Column) -> Column:
    return F.when(age.isNull(), F.lit(None).cast("boolean")).otherwise(enabled & (pending > 0) & (age > STALL_SECONDS))


def overall(unreachable: Column, mismatch: Column, is_stuck: Column) -> Column:
    return F.when(unreachable | mismatch | is_stuck, "degraded").otherwise("ok")


def consecutive_failures(events: DataFrame, key: str, failed: Column, order: list[str]) -> DataFrame:
    """Failures since the last success, for each key: no window is needed, the last success is an aggregate."""
    rows = events.select(key, F.struct(*order).alias("o"), failed.alias("f"))
    last = rows.filter("not f").groupBy(key).agg(F.max("o").alias("last"))
    return rows.select(key).distinct().join(rows.join(last, key, "left").filter(F.col("f") & (F.col("last").isNull() | (F.col("o") > F.col("last")))).groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("failures"))


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, started, n): events closer than the gap are one."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def recent_distinct(calls: DataFrame, args: str, ts: str, n: int, tie: str) -> DataFrame:
    """The latest call of each kind of arguments, latest first."""
    latest = calls.groupBy(args).agg(F.max(F.struct(ts, tie)).alias("l"))
    return latest.select(args, f"l.{ts}", f"l.{tie}").orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def dated(lines: DataFrame, order: str, seconds: str, last_day: Column) -> DataFrame:
    """Lines that only have a time of day get a date: going back from the last, each step up in time is the day before."""
    w = Window.partitionBy("log").orderBy(F.col(order).desc())
    wrap = (F.col(seconds) > F.lag(seconds).over(w)).cast("int")
    back = F.sum(F.coalesce(wrap, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("day", F.date_sub(last_day, back.cast("int")))


def duplicate_instances(beats: DataFrame, service: str, instance: str, ts: str, now: Column, interval_s: int) -> DataFrame:
    """(service, instances, duplicated): instances of a service whose last beat is no older than what counts as alive."""
    last = beats.groupBy(service, instance).agg(F.max(ts).alias("_last"))
    alive = now.cast("double") - F.col("_last").cast("timestamp").cast("double") <= STALE_BEATS * interval_s
    n = last.groupBy(service).agg(F.count_if(alive).alias("instances"))
    return n.withColumn("duplicated", F.col("instances") > 1)
