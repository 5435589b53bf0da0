"""Continuous ingest: a file source, an embedding queue in micro-batches and strikes with state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.embedding import Model, embedder
from tessera.sources import readers

STRIKES = 3


def hashing_model(width: int = 64) -> Model:
    """A deterministic stand-in for a model: unit vectors of hashed words; zero only without words."""

    def places(text: str) -> Iterator[tuple[int, int]]:
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            yield int.from_bytes(h[:4], "little") % width, 1 if h[4] & 1 else -1

    def embed(text: str) -> np.ndarray:
        v = np.zeros(width, np.float32)
        for at, sign in places(text):
            v[at] += sign
        if not v.any():  # words that cancel each other count without signs
            for at, _ in places(text):
                v[at] += 1
        n = np.linalg.norm(v)
        return v / n if n else v

    return lambda texts: [(i, embed(t)) for i, t in enumerate(texts)]


def embed(rows: DataFrame, width: int = 64, model: Model | None = None) -> DataFrame:
    """(id, embedding) of (id, text)."""
    return rows.select("id", "text").mapInArrow(embedder(model or hashing_model(width)), "id long, embedding array<float>")


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def embed_queue(stream: DataFrame, out: str, checkpoint: str, width: int = 64) -> StreamingQuery:
    """Embed what arrives; each micro-batch writes a folder of its own number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        embed(batch, width).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def strikes(stream: DataFrame, order: str | None = None) -> DataFrame:
    """(id, snapshot, strikes, quarantined) from (id, snapshot, failed): failures of one snapshot, reset by another or a success.

    order names a column that says in which order the rows of a micro-batch came.
    """

    def update(key, frames, state):
        snapshot, n = state.get if state.exists else (None, 0)
        frames = list(frames)
        if order:
            frames = [pd.concat(frames).sort_values(order, kind="stable")]
        for frame in frames:
            for s, failed in zip(frame["snapshot"], frame["failed"], strict=True):
                n = (n if s == snapshot else 0) + 1 if failed else 0
                snapshot = s
        state.update((snapshot, n))
        yield pd.DataFrame({"id": [key[0]], "snapshot": [snapshot], "strikes": [n], "quarantined": [n >= STRIKES]})

    return stream.groupBy("id").applyInPandasWithState(update, "id long, snapshot string, strikes long, quarantined boolean", "snapshot string, n long", "update", "NoTimeout")


def latest_states(stream: DataFrame, key: str, out: str, checkpoint: str) -> DataFrame:
    """Run a stateful stream over what has arrived; each key's last state so far."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(out)
    names = [c for c in stream.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("last"))
    return last.select(key, *(F.col(f"last.{c}").alias(c) for c in names))


def coalesced_scans(requests: DataFrame, scan: Callable[[], None], checkpoint: str, every: str = "300 seconds") -> StreamingQuery:
    """Scan when asked to and at least once in `every`: all that asked since the last scan is one micro-batch and one scan.

    A scan that outlasts the interval delays the next; what asks meanwhile waits for it together.
    """
    spark = requests.sparkSession
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load().select(F.lit(None).cast("string").alias("why"))
    asked = requests.select(F.lit("asked").alias("why")).unionByName(ticks)
    return asked.writeStream.foreachBatch(lambda batch, number: scan()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def debounce(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of events closer than the gap, emitted once the watermark has passed them."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def timed_calls(calls: DataFrame, ends: DataFrame, bound: str, late: str) -> DataFrame:
    """(id, elapsed_ms) of each call in a stream of log lines, with the end of the same id at most `bound` later; null without one.

    Lines may come up to `late` out of order. Behind that both sides' state is dropped and calls without an end come out.
    """
    begun = readers.tool_calls(calls).select(F.get_json_object("args", "$.id").cast("long").alias("id"), "ts").withWatermark("ts", late)
    ended = readers.call_ends(ends).select(F.col("id").alias("end_id"), F.col("ts").alias("end_ts"), "elapsed_ms").withWatermark("end_ts", late)
    within = (F.col("id") == F.col("end_id")) & (F.col("end_ts") >= F.col("ts")) & (F.col("end_ts") <= F.col("ts") + F.expr(f"interval {bound}"))
    return begun.join(ended, within, "left_outer").select("id", F.col("elapsed_ms").cast("long").alias("elapsed_ms"))


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream makes of all there is to a Parquet table, and stop; the query tells of its progress."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
