"""Joins by order and interval, rollups and the join of two streams, held to plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals
from tessera.streaming import pipelines


@pytest.fixture
def keep(spark, tmp_path):
    def written(df, name):
        df.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    return written


def test_as_of_over_ranges(spark, keep):
    """A key that fills many ranges, one without a right row, ties, nulls and rows before the first right row."""
    rng = random.Random(1)
    left = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "none", None]), rng.choice([None, *range(400)])) for i in range(600)]
    right = [(rng.choice(["hot", "a", "b", None]), rng.choice([None, *range(100, 400, 7)]), k) for k in range(90)] + [("hot", 200, 1000), ("hot", 200, 1001)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = intervals.as_of(spark.createDataFrame(left, "id long, key string, at int"), spark.createDataFrame(right, "key string, at int, v int"), "key", "at", ["v"], keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(left)
    for r in out:
        known = [(a, v) for k, a, v in right if k == r.key and k is not None and a is not None and r["at"] is not None and a <= r["at"]]
        assert r.v == (max(known)[1] if known else None)


def test_as_of_without_rows(spark, keep):
    none = spark.createDataFrame([], "key string, at int, v int")
    some = spark.createDataFrame([(1, "a", 3)], "id long, key string, at int")
    assert [tuple(r) for r in intervals.as_of(some, none, "key", "at", ["v"], keep).collect()] == [(1, "a", 3, None)]


def test_intervals_of_any_length(spark):
    rng = random.Random(2)
    points = [(i, rng.randrange(-500, 5000)) for i in range(300)] + [(900, None), (901, 77), (901, 77)]
    spans = [(k, s := rng.randrange(-600, 5000), s + rng.choice([0, 1, 59, 60, 61, 700, 100_000])) for k in range(60)] + [(70, 10, 5), (71, None, 9), (72, 77, 77)]
    met = intervals.in_intervals(spark.createDataFrame(points, "id long, at long"), spark.createDataFrame(spans, "span long, lo long, hi long"), "at", "lo", "hi")
    want = sorted((i, k) for i, p in points for k, a, b in spans if p is not None and a is not None and a <= p <= b)
    assert sorted((r.id, r.span) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.in_intervals(spark.createDataFrame(points, "id long, at long"), spark.createDataFrame([], "span long, lo long, hi long"), "at", "lo", "hi").count() == 0


def test_disc_at_is_the_sorted_value(spark):
    for n in (1, 2, 3, 4, 20, 99, 100):
        rows = spark.createDataFrame([(float(x * 3 % 101),) for x in range(n)], "x double")
        values = sorted(r.x for r in rows.collect())
        got = rows.agg(*(intervals.disc_at("x", s).alias(f"s{k}") for k, s in enumerate((0.5, 0.95, 1.0)))).first()
        assert list(got) == [values[min(n - 1, int(n * s))] for s in (0.5, 0.95, 1.0)]


def test_calls_meet_their_ends_and_state_goes(spark, tmp_path):
    """An end too late or without a call meets nothing; once time has moved on neither side holds old rows."""
    at = lambda s: (dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)).isoformat(timespec="microseconds") + "Z"
    call = lambda i, s: f'{at(s)} INF mcp-call search {{"id": {i}}}'
    end = lambda i, s, ms: f"{at(s)} INF mcp-tool tool=search id={i} elapsedMs={ms}"
    log, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("log", "out", "checkpoint"))

    def run(lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(log)
        return pipelines.append_to(pipelines.timed_calls(spark.readStream.text(log), spark.readStream.text(log), "20 seconds", "1 minute"), out, checkpoint)

    run([end(1, 5, 5000), call(1, 0), call(2, 1), end(2, 30, 29000), call(3, 2), end(9, 3, 1), "no call at all", call(4, 40)])
    run([end(4, 50, 10000)])
    got = lambda: sorted(((r.id, r.elapsed_ms) for r in spark.read.schema("id long, elapsed_ms long").parquet(out).collect()), key=str)
    assert got() == [(1, 5000), (4, 10000)]
    last = run([call(77, 10_000), end(78, 10_000, 1)])
    assert got() == [(1, 5000), (2, None), (3, None), (4, 10000)]
    assert sum(s["numRowsTotal"] for s in last.lastProgress["stateOperators"]) <= 2


def test_rollups(spark):
    from tessera.operators.archive import rollups

    messages = spark.createDataFrame([(1, "a", dt.datetime(2026, 1, 5), None), (2, "b", None, None), (3, "a", dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 2))], "id long, folder string, date_sent timestamp_ntz, deleted_at timestamp_ntz")
    parts = spark.createDataFrame([(1, "done", None, 10), (1, None, "m", 5), (2, "done", None, 1), (3, "done", None, 100)], "message_id long, extraction_status string, ocr_model string, size_bytes long")
    out = {(r.sets, r.folder, r.status, r.engine, r.month): (r.attachments, r.messages, r.bytes) for r in rollups(parts, messages).collect()}
    assert out[15, None, None, None, None] == (3, 2, 16) and out[7, "a", None, None, None] == (2, 1, 15) and out[6, "a", None, None, "2026-01"] == (2, 1, 15)
    assert out[11, None, "done", None, None] == (2, 2, 11) and out[11, None, "pending", None, None] == (1, 1, 5) and out[13, None, None, "m", None] == (1, 1, 5) and len(out) == 9


def test_sketches_of_parts_are_those_of_the_whole(spark, tmp_path):
    from tessera.operators import sketches
    from tessera.sources.versions import VersionLog

    rows = spark.range(20_000).selectExpr("id % 3 as k", "id % 7 as day", "cast(pmod(id * 7919, 20011) as double) as v", "id % 900 as u")
    log = VersionLog(spark, f"file://{tmp_path}/s")
    for part in ("day < 3", "day = 3 and v < 9000", "day >= 3 and not (day = 3 and v < 9000)"):
        sketches.append(log, sketches.sketched(rows.filter(part), ["k", "day"], "v", "u"), ["k", "day"])
    held = log.read(sketches.TABLE)
    assert held.count() == 21 and held.agg({"n": "sum"}).first()[0] == 20_000
    exact = {r.k: sorted(r.v) for r in rows.groupBy("k").agg({"v": "collect_list"}).toDF("k", "v").collect()}
    for made in (sketches.merged(held, ["k"]), sketches.sketched(rows, ["k"], "v", "u")):
        for r in made.select("k", "n", sketches.distinct_count("distinct").alias("u"), *(sketches.quantile("quantiles", s).alias(f"q{s}") for s in (0.1, 0.5, 0.95))).collect():
            assert r.n == len(exact[r.k]) and abs(r.u - 300) <= 15
            for s in (0.1, 0.5, 0.95):
                rank = sum(x <= r[f"q{s}"] for x in exact[r.k]) / r.n
                assert abs(rank - s) <= 2 * sketches.RANK_ERROR


def test_totals_over_intervals_without_pairs(spark):
    """Intervals of no length to all, points on their ends, before 1970, nulls; a thousand intervals over all points make no million of rows."""
    rng = random.Random(7)
    zero = dt.datetime(1970, 1, 1)
    time = lambda micros: None if micros is None else zero + dt.timedelta(microseconds=micros)
    points = [(f"p{k}", rng.choice([None, rng.randrange(-3000, 3000), rng.randrange(10**12)]), rng.choice([None, 1, 5])) for k in range(300)]
    at = [a for _, a, _ in points if a is not None]
    spans = [(k, rng.choice(at) + rng.choice([-1, 0, 1]), rng.choice([0, 1, 2, 63, 64, 5000, 10**10, 2 * 10**12])) for k in range(120)]
    spans = [(k, lo, lo + n) for k, lo, n in spans] + [(500, 10, 5), (501, None, 9), (502, at[0], at[0]), (503, at[1] + 1, at[1])]
    rows = spark.createDataFrame([(n, time(a), v) for n, a, v in points], "name string, at timestamp_ntz, v long")
    held = spark.createDataFrame([(k, time(a), time(b)) for k, a, b in spans], "span long, lo timestamp_ntz, hi timestamp_ntz")
    parts = [("n", F.lit(1).cast("long"), F.sum), ("first", F.col("name"), F.min), ("total", F.col("v"), F.sum)]
    got = {r.span: (r.n, r.first, r.total) for r in intervals.over_intervals(rows, held, "at", "lo", "hi", "span", parts).collect()}
    want = {}
    for k, lo, hi in spans:
        if lo is not None and (inside := [(n, v) for n, a, v in points if a is not None and lo <= a <= hi]):
            values = [v for _, v in inside if v is not None]
            want[k] = (len(inside), min(n for n, _ in inside), sum(values) if values else None)
    assert got == want
    assert intervals.over_intervals(rows, held.limit(0), "at", "lo", "hi", "span", parts).count() == 0


def test_files_of_scans_makes_no_pairs():
    import inspect

    from tessera.plans import upkeep_queries

    assert "in_intervals" not in inspect.getsource(upkeep_queries.files_of_scans)
