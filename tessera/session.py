"""Session defaults. A caller's own session is never reconfigured by the operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tessera", cores: str | int | None = None, **conf: str) -> SparkSession:
    cores = cores or os.environ.get("TESSERA_CPUS", "*")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=defaults).getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """A table over all cores where its files leave most of them idle, as a single row group does; else as it is.

    For what costs far more than to move its input. It looks at the splits of a scan and runs nothing; a plan that shuffles
    anyway is left alone, and so is a table of more splits than a quarter of the cores.
    """
    if rows._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if 4 * rows._jdf.rdd().getNumPartitions() > cores else rows.repartition(cores)
