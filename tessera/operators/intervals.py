"""Joins by order and by interval, without a nested loop and without a task that holds a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]
#: A column's name, a row's value for it and the aggregate that merges values, be they rows' or merged ones.
Merged = tuple[str, Column, Callable[[str], Column]]


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, payload: list[str], keep: Keep) -> DataFrame:
    """Each row of left with the columns `payload` of the last row of right that has its `by` and is at or before its `at`.

    Both sides are sorted together once, by ranges of (by, at), so a busy key spreads over as many ranges as it fills. Within a
    range the last row of right is carried along; over ranges one row each tells what the next one begins with. keep writes
    a table and reads it back, which fixes the ranges. A null key or time meets nothing. Among rows of right with one key and
    time that with the greatest payload counts.
    """
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    carried = F.struct(*payload).alias("_r")
    rows = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), none("_r", right.select(carried).schema[0].dataType), F.struct("*").alias("_row"))
    known = right.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    known = known.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"), carried, none("_row", rows.schema["_row"].dataType))
    salt = F.xxhash64("_row")  # parts what shares key and time
    rows = keep(rows.unionByName(known).repartitionByRange("_by", "_at", "_side", salt).withColumn("_range", F.spark_partition_id()), "ranges")
    order = [F.col("_at").asc_nulls_first(), F.col("_side"), F.col("_r")]
    within = Window.partitionBy("_range", "_by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # What a range hands on: its last row of right, under the key of that row.
    hands = rows.groupBy("_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_by", "_at", "_r"))).alias("_hands"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = hands.select("_range", F.last("_hands", ignorenulls=True).over(before).alias("_begins"))
    out = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(within)).filter("_side = 1").join(F.broadcast(begins), "_range")
    earlier = F.when((F.col("_begins._by") == F.col("_by")) & F.col("_at").isNotNull(), F.col("_begins._r"))
    met = F.coalesce(F.when(F.col("_at").isNotNull(), F.col("_last")), earlier)
    return out.select("_row.*", *(met[c].alias(c) for c in payload))


def in_intervals(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, unit: int = 60, salts: int = 8) -> DataFrame:
    """Pairs of a point and an interval with begin <= at <= end, columns of both; times are seconds or timestamps.

    An interval belongs to the level of its length, units times a power of two, and touches at most two cells of that level;
    a point stands in one cell of every level that there is. So both meet by equality, however long intervals are. Points of one
    cell are dealt to `salts` parts, in each of which its intervals stand. What ends before it begins, and nulls, meet nothing.
    """
    seconds = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") if points_are_times else F.col(c)).cast("long")
    points_are_times = dict(points.dtypes)[at].startswith(("timestamp", "date"))
    level = F.greatest(F.lit(0), F.ceil(F.log2((seconds(end) - seconds(begin) + 1) / F.lit(float(unit))))).cast("int")
    held = intervals.filter(F.col(begin) <= F.col(end)).withColumn("_level", level)
    levels = [r._level for r in held.select("_level").distinct().collect()]  # 64 at most
    width = F.lit(unit).cast("long") * F.expr("shiftleft(1L, _level)")
    cells = F.array_distinct(F.array(F.floor(seconds(begin) / width), F.floor(seconds(end) / width)))
    held = held.withColumn("_cell", F.explode(cells)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    rows = rows.withColumn("_cell", F.floor(seconds(at) / width)).withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    met = rows.join(held, ["_level", "_cell", "_salt"])
    return met.filter((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))).drop("_level", "_cell", "_salt")


def over_intervals(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, key: str, parts: list[Merged]) -> DataFrame:
    """(key, and a column for each of parts) of the points with begin <= at <= end, for each interval that has any; times are timestamps.

    parts are (column, a row's value, what merges values); they are merged as sum, min and max are. No pairs are made: points are merged
    at every level of blocks of 2, 4, 8, ... microseconds, as far as intervals are long, and an interval is made up of two blocks a level
    at most. So the work goes with the points and with the intervals, not with what an interval holds. Intervals of one key are one. What
    ends before it begins, and nulls, meet nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = intervals.filter(F.col(begin) <= F.col(end)).select(key, micros(begin).alias("_lo"), (micros(end) + 1).alias("_hi"))
    longest = held.agg(F.max(F.col("_hi") - F.col("_lo")).alias("n")).first().n or 1
    levels = longest.bit_length()
    merged = lambda rows, *by: rows.groupBy(*by).agg(*(merge(name).alias(name) for name, _, merge in parts))
    names = [name for name, _, _ in parts]
    blocks = merged(points.filter(F.col(at).isNotNull()).select(micros(at).alias("_block"), *(value.alias(name) for name, value, _ in parts)), "_block")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    blocks = merged(blocks.select(every, "_block", *names).withColumn("_block", F.expr("shiftright(_block, _level)")), "_level", "_block")

    def ends(k):
        """The blocks of level k that begin or end an interval and that no block of level k + 1 inside it holds."""
        one = F.lit(1).cast("long")
        low, high = F.call_function("shiftright", F.col("_lo") + F.call_function("shiftleft", one, k) - 1, k), F.call_function("shiftright", F.col("_hi"), k)
        odd = lambda c: c.bitwiseAND(one) == 1
        return F.array(F.when((low < high) & odd(low), low), F.when((low < high) & odd(high), high - 1))

    cover = held.select(key, every, "_lo", "_hi").select(key, "_level", F.explode(ends(F.col("_level"))).alias("_block")).filter("_block is not null")
    return merged(cover.join(blocks, ["_level", "_block"]), key)


def disc_at(values: str, share: float) -> Column:
    """The value at floor(share * n) of a group's sorted values, the last at most: from counts of distinct values, merged part by part."""
    return F.expr(f"percentile_disc({min(1.0, share + 1e-12)!r}D) within group (order by {values})")
