import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters, fusion, health, ingest, ocr, vectors
from tessera.sources import readers


def test_dates():
    assert filters.parse_date(" ") is None and filters.parse_date("2026-01-02") == dt.datetime(2026, 1, 2)
    assert filters.parse_date("2026-01-02", True) == dt.datetime(2026, 1, 2, 23, 59, 59, 999999)
    assert filters.parse_date("2026-01-02T10:00:00+02:00") == dt.datetime(2026, 1, 2, 8)
    with pytest.raises(ValueError):
        filters.parse_date("soon")
    assert filters.clamp_limit(None) == 20 and filters.clamp_limit(0) == 20 and filters.clamp_limit(500) == 100
    assert filters.SearchFilters().is_empty and not filters.SearchFilters(folder="x").is_empty


def test_filters_treat_wildcards_as_letters(spark):
    m = spark.createDataFrame([(1, "a_b@x", None), (2, "aXb@x", "50%"), (3, "c@x", "a_b")], "id long, from_address string, from_name string")
    ids = lambda **f: {r.id for r in filters.apply_filters(m, filters.SearchFilters(**f)).collect()}
    assert ids(from_contains="A_b") == {1, 3} and ids(from_contains="%") == {2} and ids(from_exact="C@X") == {3}


def test_one_hot_neighbours_and_best_chunk(spark):
    hot = lambda i: [1.0 if k == i else 0.0 for k in range(8)]
    chunks = spark.createDataFrame([(i, i // 2, hot(i % 8), None) for i in range(16)], "id long, message_id long, embedding array<float>, attachment_id long")
    q = spark.createDataFrame([(hot(3),)], "q array<float>")
    assert [r.id for r in vectors.knn(chunks, q, 3).collect()] == [3, 11, 0]
    messages = spark.createDataFrame([(i,) for i in range(8) if i != 1], "id long")
    got = vectors.semantic_search(chunks, messages, q, 2).collect()
    assert [(r.message_id, r.chunk_id) for r in got] == [(5, 11), (0, 0)]
    assert [r.message_id for r in vectors.semantic_search(chunks, messages, q, 5, horizon=2).collect()] == [5]


def test_vector_states(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([0.0, 0.0],), ([nan, 1.0],), ([inf, 0.0],), ([0.3, 0.0],), ([3.0, 0.0],), ([1.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.audit_class(F.col("v"))).collect()] == ["zero", "not_finite", "not_finite", "low_norm", "high_norm", "ok"]
    assert df.select(vectors.cosine(F.col("v"), F.array(F.lit(1.0)))).first()[0] == 0.0
    assert [r[0] for r in df.select(vectors.normalized(F.col("v"))).collect()][4] == [1.0, 0.0]


def test_fusion_order(spark):
    kw = spark.createDataFrame([(1, 1), (2, 2)], "id long, kw_rank int")
    vec = spark.createDataFrame([(2, 2), (3, 1)], "id long, vec_rank int")
    assert [r.id for r in fusion.fuse(kw, vec, 10).collect()] == [2, 1, 3]


def test_upsert_flags(spark):
    kinds = "message_id string, folder string, content_hash string, embed_epoch long, embedded_at timestamp, deleted_at timestamp"
    now = dt.datetime(2026, 1, 1)
    current = spark.createDataFrame([("same", "a", "h", 1, now, None), ("edit", "a", "h", 1, now, None), ("nohash", "a", None, 1, now, None), ("copy", "a", "h", 1, now, None), ("back", "a", "h", 1, now, now), ("gone", "a", "h", 1, now, now)], kinds)
    staged = spark.createDataFrame([("same", "a", "h"), ("edit", "a", "x"), ("nohash", "a", "x"), ("copy", "b", "x"), ("back", "b", "h"), ("new", "c", "n")], "message_id string, folder string, content_hash string")
    r = {x.message_id: x for x in ingest.upsert_messages(current, staged).collect()}
    assert r["new"].is_new and not r["new"].embedded and not r["same"].changed and r["edit"].changed and r["edit"].embed_epoch == 2 and not r["edit"].embedded
    assert not r["nohash"].changed and r["nohash"].content_hash == "x" and not r["copy"].changed and r["copy"].content_hash == "h" and r["copy"].folder == "a"
    assert not r["back"].deleted and r["back"].folder == "b" and r["gone"].deleted


def test_guards_and_vetoes():
    assert ingest.deletion_vetoed(5, 9, 1) and ingest.deletion_vetoed(0, 9, 0) and not ingest.deletion_vetoed(0, 0, 0) and not ingest.deletion_vetoed(3, 9, 0)
    assert ingest.space_conflict({}, {"model": "m"}) is None and ingest.space_conflict({"model": "x"}, {"model": "m"}) == "model" and ingest.space_conflict({"drift": "1"}, {}) == "drift"


def test_candidates_with_missing_types(spark):
    rows = [(1, 1, None, "a.tiff", None, 60_000), (2, 1, None, None, None, 60_000), (3, 1, "image/gif", "x.png", None, 60_000), (4, 1, "image/png", None, None, 10), (5, 1, "", "b.JPG", "unsupported", 60_000)]
    a = spark.createDataFrame(rows, "id long, message_id long, content_type string, filename string, extraction_status string, size_bytes long")
    m = spark.createDataFrame([(1, None)], "id long, deleted_at timestamp")
    assert {r.id for r in ocr.image_candidates(a, m).collect()} == {1, 5}
    assert ocr.counts(a).first().image_pending == 3


def test_logs_and_status_files(spark):
    lines = spark.createDataFrame([('2026-01-01T10:00:00Z info mcp-call search_emails {"q": 1}',), ("noise",), ('x info mcp-call t {"a": "}"}',)], "value string")
    got = readers.tool_calls(lines).collect()
    assert [(r.tool, json.loads(r.args)) for r in got] == [("search_emails", {"q": 1}), ("t", {"a": "}"})] and got[1].ts is None
    status = readers.status_file(spark.createDataFrame([("2026-01-01 10:00:00\n300\n",)], "value string")).first()
    assert status.interval_s == 300 and status.finished == dt.datetime(2026, 1, 1, 10)
    assert readers.status_file(spark.createDataFrame([("junk",)], "value string")).first().finished is None


def test_query_sets_and_labels():
    good = {"queries": [{"id": "a", "query": "x", "relevant": ["m", {"messageId": "n", "grade": 3}]}]}
    assert readers.load_query_set(json.dumps(good))[0]["relevant"][1]["grade"] == 3.0
    for bad in ({"id": "a"}, {"id": "a", "relevant": ["m"], "expectEmpty": True}, {"relevant": ["m"]}):
        with pytest.raises(ValueError):
            readers.load_query_set(json.dumps({"queries": [bad]}))
    with pytest.raises(ValueError):
        readers.load_query_set(json.dumps({"queries": good["queries"] * 2}))
    assert readers.parse_label("a=b@x=2") == ("a=b@x", 2.0) and readers.parse_label("a=b") == ("a=b", 1.0)


def test_versions_are_published_whole(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    readers.publish(spark.range(3), root)
    first = readers.current(spark, root)
    readers.publish(spark.range(5), root)
    assert first.count() == 3 and readers.current(spark, root).count() == 5


def test_mail_folders(spark, tmp_path):
    for folder, name in (("cur", "1"), ("Work/Sub/new", "2"), ("Work/tmp", "3")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / name).write_bytes(b"Subject: hello\r\nFrom: a@x\r\n\r\nbody")
    files = readers.maildir(spark, str(tmp_path))
    assert {r.folder for r in files.collect()} == {"INBOX", "Work/Sub"}
    assert {(r.folder, r.subject, r.body_text) for r in readers.parse_mail(files).collect()} == {("INBOX", "hello", "body"), ("Work/Sub", "hello", "body")}


def test_health(spark):
    row = spark.range(1)
    val = lambda c: row.select(c).first()[0]
    n = F.lit(None).cast("int")
    assert val(health.liveness(n, F.lit(60))) == "unknown" and val(health.liveness(F.lit(181), F.lit(60))) == "stale" and val(health.liveness(F.lit(180), F.lit(60))) == "alive"
    assert val(health.ocr_stalled(F.lit(True), F.lit(1), n)) is None and val(health.sync_window(F.lit(10))) == 1800


def test_texts_over_the_context_are_halved():
    from tessera.functions import embedding as E

    sent = []

    def model(texts):
        sent.append([len(t) for t in texts])
        if max(map(len, texts)) > 100 or len(texts) > 4:
            raise E.InputTooLong
        return [(i, [len(t)]) for i, t in enumerate(texts)][::-1]

    assert E.embed_texts(model, ["a" * n for n in (10, 150, 90, 1000, 3, 7)]) == [[10], [75], [90], [62], [3], [7]]
    assert sent[0] == [10, 150, 90, 1000, 3, 7] and E.embed_texts(model, []) == []

    def never(texts):
        raise E.InputTooLong

    with pytest.raises(E.InputTooLong):
        E.embed_texts(never, ["a" * 5000])
    with pytest.raises(E.InputTooLong):
        E.embed_texts(never, ["short"])


@pytest.mark.parametrize("answer", [[(0, [1])], [(0, [1]), (0, [2])], [(0, [1]), (2, [2])], [(0, [1]), (-1, [2])], [(0, [1]), (None, [2])], [(0, [1]), (1, None)]])
def test_answers_are_put_back_by_index(answer):
    from tessera.functions import embedding as E

    assert E.reassemble([(1, [2]), (0, [1])], 2) == [[1], [2]]
    with pytest.raises(E.InvalidResponse):
        E.reassemble(answer, 2)


def test_a_sweep_passes_over_what_backs_off_and_wraps(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "id long")
    waiting = spark.createDataFrame([(2, 9), (3, 9), (4, 3)], "id long, until int")
    step = lambda cursor, size: [tuple(r) for r in ocr.next_page(rows, "id", cursor, size, waiting, 5).orderBy("id").collect()]
    assert step(0, 2) == [(1, True), (2, False), (3, False), (4, True)]
    assert step(8, 5) == [(9, True), (10, True)]
    assert step(10, 1) == [(1, True)]
    assert ocr.next_page(rows.filter("false"), "id", 5, 3, waiting, 5).count() == 0


def test_documents_are_retired_only_when_the_model_can_run(spark):
    ok, bad = None, "transient"
    rows = [(1, c, bad, False) for c in range(6)] + [(2, c, ok, False) for c in range(5)]  # five cycles with a success
    rows += [(3, c, bad, False) for c in range(10, 20)]  # nothing ran in these
    rows += [(4, c, bad, True) for c in range(20, 25)]  # a probe did
    rows += [(5, 3, "document_fatal", False), (6, 3, "backpressure", False), (7, 3, "auth_or_config", False)]
    df = spark.createDataFrame(rows, "id long, cycle long, kind string, probe_ok boolean")
    assert {r.id: (r.counted, r.retired) for r in ocr.retirements(df, "id").collect()} == {1: (5, True), 2: (0, False), 3: (0, False), 4: (5, True), 5: (0, True), 6: (0, False), 7: (0, False)}


def test_hint_for_an_empty_archive(spark):
    from tessera.operators import archive

    rows = spark.range(3)
    hint = lambda df, known: archive.empty_hint(df, known, "/a").first().hint
    assert hint(rows, True) is None
    assert "ingested" in hint(rows.filter("false"), True) and "never set up" in hint(rows.filter("false"), False)


def test_parts_are_read_within_the_folder(spark):
    from email.message import EmailMessage

    m = EmailMessage()
    m.set_content("body")
    m.add_attachment(b"12345", maintype="application", subtype="pdf", filename="a.pdf")
    m.add_attachment(b"x" * 50, maintype="image", subtype="png", filename="b.png")
    rows = [("/mail/cur/1", m.as_bytes(), n) for n in (0, 1, 2, -1, None)] + [("/mail/cur/../../etc/1", m.as_bytes(), 0), ("/mailbox/1", m.as_bytes(), 0), ("/mail/cur/2", None, 0)]
    out = readers.part_bytes(spark.createDataFrame(rows, "path string, content binary, part_index int"), "/mail", 10).collect()
    assert [(r.filename, bytes(r.data) if r.data else None, r.error) for r in out] == [
        ("a.pdf", b"12345", None), ("b.png", None, "oversize"), *[(None, None, "no_part")] * 3, *[(None, None, "outside")] * 2, (None, None, "no_part"),
    ]


def test_requests_are_coalesced_into_scans(spark, tmp_path):
    import time

    from tessera.streaming import pipelines

    src = f"file://{tmp_path}/in"
    spark.range(50).repartition(5).write.parquet(src)
    scans = []
    q = pipelines.coalesced_scans(pipelines.file_stream(spark, src, "id long"), lambda: scans.append(1), f"file://{tmp_path}/cp", "3 seconds")
    try:
        until = time.monotonic() + 60
        while len(scans) < 2 and time.monotonic() < until:  # the second is the timer's: nothing has asked
            time.sleep(0.2)
        assert 2 <= len(scans) <= 4
    finally:
        q.stop()


def test_spread_moves_only_what_cannot_be_split(spark, tmp_path):
    from tessera.session import spread

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/many")
    one = spark.read.parquet(f"{tmp_path}/one")
    wide = spread(one)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == 100
    many = spark.read.parquet(f"{tmp_path}/many").repartition(9).select("id")
    assert spread(many) is many
    joined = one.join(one.withColumnRenamed("id", "other").hint("merge"), F.col("id") == F.col("other"))
    assert spread(joined) is joined


def test_tail_of_a_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.log").write_text("".join(f"old {k}\n" for k in range(500)))
    (log / "b.log").write_bytes(b"")
    (log / "c.log").write_text("n1\n\nn3 \u00e9\nunfinished")
    said = lambda n, chunk=7: [(r.value, r.back) for r in readers.tail(spark, str(log), n, chunk).orderBy("back").collect()]
    assert said(3) == [("unfinished", 1), ("n3 \u00e9", 2), ("", 3)]
    assert said(6) == [("unfinished", 1), ("n3 \u00e9", 2), ("", 3), ("n1", 4), ("old 499", 5), ("old 498", 6)]
    assert len(said(1000, 1 << 16)) == 504
