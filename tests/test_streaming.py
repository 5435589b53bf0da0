import datetime as dt

from tessera.streaming import pipelines


def test_embedding_queue(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(i, f"text {i % 3} words") for i in range(20)] + [(99, None)], "id long, text string")
    rows.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        q = pipelines.embed_queue(pipelines.file_stream(spark, src, rows.schema), out, f"file://{tmp_path}/cp")
        q.awaitTermination(60)
    got = {r.id: r.embedding for r in spark.read.parquet(out).collect()}
    assert len(got) == 21 and got[0] == got[3] and got[0] != got[1] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[99]) == {0.0}


def test_strikes_follow_the_snapshot(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [(1, "a", True), (1, "a", True), (1, "a", True), (2, "a", True), (2, "b", True), (3, "a", True), (3, "a", False)]
    df = spark.createDataFrame(rows, "id long, snapshot string, failed boolean")
    df.coalesce(1).write.parquet(src)
    q = pipelines.strikes(pipelines.file_stream(spark, src, df.schema)).writeStream.format("memory").queryName("strikes").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.id: (r.snapshot, r.strikes, r.quarantined) for r in spark.sql("select * from strikes").collect()}
    assert got == {1: ("a", 3, True), 2: ("b", 1, False), 3: ("a", 0, False)}


def test_debounce(spark, tmp_path):
    src, t0 = f"file://{tmp_path}/in", dt.datetime(2026, 1, 1)
    at = [0, 1, 2, 100, 101, 900]
    df = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s)) for s in at], "k string, ts timestamp")
    df.write.parquet(src)
    q = pipelines.debounce(pipelines.file_stream(spark, src, df.schema), "ts", "k", "10 seconds", "0 seconds").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("select * from sessions").collect()) == [2, 3]
