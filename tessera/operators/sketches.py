"""Sketches that are stored by day and merged: quantiles (KLL) and distinct counts (HyperLogLog) of what is too much to keep.

A sketch is a few kilobytes whatever it has seen. Those of parts merge into one of the whole, so a report over months reads one row a
day and key, and a new day is added without a look at the old ones. The exact forms stand beside them: intervals.disc_at() and
count_distinct().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.versions import Snapshot, VersionLog

#: Sizes: KLL's k, with a normalised rank error of about 0.013 at 200; HyperLogLog's log2 of registers, 1.6 % at 12.
QUANTILES_K, DISTINCT_K, RANK_ERROR, DISTINCT_ERROR = 200, 12, 0.0133, 0.016
TABLE = "sketches"


def sketched(rows: DataFrame, keys: list[str], value: str, distinct: str) -> DataFrame:
    """(keys, n, quantiles, distinct): n counts rows; a null value or distinct cell is in no sketch."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILES_K).alias("quantiles"),
        F.hll_sketch_agg(distinct, DISTINCT_K).alias("distinct"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same for coarser keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(sketch: str | Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def distinct_count(sketch: str | Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def append(log: VersionLog, new: DataFrame, keys: list[str]) -> Snapshot:
    """Add sketches of new rows to those of a version log; keys that both have are merged, the others stay as they are."""

    def change(at: Snapshot) -> dict[str, DataFrame]:
        if TABLE not in at.tables:
            return {TABLE: new}
        old = log.read(TABLE, at)
        touched = new.select(*keys).distinct()
        both = merged(old.join(touched, keys, "left_semi").unionByName(new), keys)
        return {TABLE: old.join(touched, keys, "left_anti").unionByName(both)}

    return log.update(change)
