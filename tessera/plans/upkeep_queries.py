"""Queries over what keeps an archive going: models, readings, logs, settings; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.functions.embedding import InputTooLong
from tessera.operators import archive, health, ingest, intervals, ocr, sketches, vectors
from tessera.operators.archive import stamp
from tessera.plans.archive_queries import ORACLES, QUERIES, A, C, M, S, kept, query, scratch_path, when
from tessera.sources import readers
from tessera.sources.versions import VersionLog

__all__ = ["ORACLES", "QUERIES"]
CONTEXT = 512


def short_model(texts: list[str]) -> list[tuple[int, list[float]]]:
    """A model with a context of CONTEXT characters a text and 4 texts' worth a batch, whose answers come last first."""
    if max(map(len, texts)) > CONTEXT or sum(map(len, texts)) > 4 * CONTEXT:
        raise InputTooLong
    return [(i, [float(len(t))]) for i, t in enumerate(texts)][::-1]


@query(f"select doc_id as id, (length(text) >> list_min(list_filter(range(0, 40), lambda k: (length(text) >> k) <= {CONTEXT}))::int)::bigint as used from documents")
def embed_fallback(t):
    """How much of each text a model of short context has seen: batches are halved, single texts cut by halves."""
    from tessera.streaming.pipelines import embed

    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    return embed(rows, model=short_model).select("id", F.element_at("embedding", 1).cast("long").alias("used"))


@query("select message_id, count(*)::bigint as chunks from chunks group by message_id", C)
def chunk_counts(t):
    return vectors.chunk_counts(t.chunks)


@query("select doc_id, md5('search: ' || text) as asked, md5(text || ' </d>') as stored from documents")
def embedding_policy(t):
    asked, stored = vectors.input_text(F.col("text"), "search: ", ""), vectors.input_text(F.col("text"), "", " </d>")
    return t.documents.select("doc_id", F.md5(asked).alias("asked"), F.md5(stored).alias("stored"))


@query("select id, (embed_epoch + (embedded_at is not null)::int)::bigint as embed_epoch, false as embedded from messages", M)
def switch_model(t):
    out, _ = ingest.switch_model(t.messages, {"model": "next"})
    return out.select("id", "embed_epoch", F.col("embedded_at").isNotNull().alias("embedded"))


TRIED = """tried as (select user_id as id, event_id // 20 as cycle, case event_type when 'error' then case when event_id % 31 = 0 then 'document_fatal' else 'transient' end
  when 'click' then case when event_id % 2 = 0 then 'transient' else 'backpressure' end when 'view' then null else 'auth_or_config' end as kind, event_id % 17 = 0 as probe_ok from events)"""


def _tried(t):
    e = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "error", F.when(e % 31 == 0, "document_fatal").otherwise("transient"))
        .when(F.col("event_type") == "click", F.when(e % 2 == 0, "transient").otherwise("backpressure"))
        .when(F.col("event_type") != "view", "auth_or_config")
    )
    return t.events.select(F.col("user_id").alias("id"), F.floor(e / 20).alias("cycle"), kind.alias("kind"), (e % 17 == 0).alias("probe_ok"))


@query(f"with {TRIED} select id, count(*) filter (where kind = 'transient' and healthy)::bigint as counted, bool_or(coalesce(kind = 'document_fatal', false)) or count(*) filter (where kind = 'transient' and healthy) >= 5 as retired from (select *, bool_or(kind is null or probe_ok) over (partition by cycle) as healthy from tried) group by id")
def ocr_retirements(t):
    return ocr.retirements(_tried(t), "id")


@query(f"with {TRIED} select case when kind in ('backpressure', 'auth_or_config') then 'abort_batch' when kind = 'document_fatal' then 'retire' else 'count' end as action, count(*)::bigint as n from tried where kind is not null group by action")
def ocr_failure_actions(t):
    rows = _tried(t).filter("kind is not null")
    return rows.groupBy(ocr.failure_action(F.col("kind")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("select id, attempt from (select *, count(*) filter (where attempt) over (order by id rows between unbounded preceding and 1 preceding) as done from (select id, id % 3 <> 0 or id % 2 <> 0 as attempt from (select id from attachments where id > 30 order by id limit 256))) where coalesce(done, 0) < 20", A)
def ocr_next_page(t):
    waiting = t.attachments.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, 9).otherwise(4).alias("until"))
    return ocr.next_page(t.attachments, "id", 30, 20, waiting, 5)


@query("select user_id, count(*) filter (where epoch(timestamp '2024-01-15 00:00:00' - last) <= 3 * 86400)::bigint as instances, count(*) filter (where epoch(timestamp '2024-01-15 00:00:00' - last) <= 3 * 86400) > 1 as duplicated from (select user_id, event_type, max(ts) as last from events group by all) group by user_id")
def duplicate_instances(t):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return health.duplicate_instances(t.events, "user_id", "event_type", "ts", now, 86400)


@query("select count(*)::bigint as n_messages, case when count(*) = 0 then 'empty' end as hint from messages", M)
def empty_archive_hint(t):
    return archive.empty_hint(t.messages, True, "/archive").withColumn("hint", F.when(F.col("hint").isNotNull(), "empty"))


@query("select key, value from (select 'user' || user_id as key, arg_max(case when event_type <> 'error' then props end, event_id) filter (where true) as value, arg_max(event_type, event_id) as kind from events group by 1) where kind <> 'error' union all select 'kept', 'x'")
def settings_after_changes(t):
    """Set and delete: an error deletes its user's setting."""
    current = t.spark.createDataFrame([("kept", "x"), ("user1", "old")], "key string, value string")
    changes = t.events.select(F.concat(F.lit("user"), "user_id").alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"), F.col("event_id").alias("at"))
    return ingest.apply_values(current, changes)


@query(f"select {when('ts')} as ts, event_type as tool, props as args from events")
def call_log(t):
    """Calls written as a text log and read again; what a call took is a line of its own and no call."""
    path = scratch_path(t.spark, "calls")
    readers.write_calls(t.events.select("ts", F.col("event_type").alias("tool"), F.col("props").alias("args"), F.col("value").alias("elapsed_ms")), path)
    return readers.tool_calls(t.spark.read.text(path)).select(stamp("ts").alias("ts"), "tool", "args")


PARTED = "From: a@x.example\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nbody\r\n--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\nContent-Transfer-Encoding: base64\r\n\r\n{0}\r\n--b--\r\n"


@query("select doc_id, case when doc_id % 7 = 1 then 'outside' when doc_id % 7 = 2 then 'no_part' when strlen(text) > 5000 then 'oversize' end as error, case when not (doc_id % 7 in (1, 2) or strlen(text) > 5000) then md5(text) end as digest from documents")
def attachment_bytes(t):
    """One part of each message: some paths lead out of the folder, some parts are not there, some are too large."""
    i = F.col("doc_id")
    path = F.concat(F.when(i % 7 == 1, "/mail/../else/").otherwise("/mail/in/../cur/"), i.cast("string"))
    head, tail = PARTED.split("{0}")
    content = F.concat(F.lit(head), F.base64(F.encode("text", "UTF-8")), F.lit(tail)).cast("binary")
    files = t.wide.documents.select(path.alias("path"), content.alias("content"), F.when(i % 7 == 2, 1).otherwise(0).alias("part_index"))
    out = readers.part_bytes(files, "/mail", 5000)
    return out.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "error", F.md5("data").alias("digest"))


@query("select source, count(*)::bigint as n from documents where lang <> 'de' group by source")
def published_version(t):
    """Two versions of a table are written; the one named last is read."""
    root = scratch_path(t.spark, "versions")
    counts = lambda rows: rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    readers.publish(counts(t.documents), root)
    readers.publish(counts(t.documents.filter("lang <> 'de'")), root)
    return readers.current(t.spark, root)


@query("select query_id, grade, count(*)::bigint as n from qrels group by all", "qrels")
def report_round_trip(t):
    path = scratch_path(t.spark, "report")
    readers.write_report(t.qrels.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.schema("query_id string, grade double, n long").json(path)


@query("select doc_id, md5(text) as digest from documents")
def charset_ladder(t):
    """Texts as UTF-8 under no name and, be they ASCII or not, under that of ASCII, and as UTF-16 under its own."""
    kind = F.col("doc_id") % 3
    data = F.when(kind == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    named = F.when(kind == 1, "utf-16").when(kind == 2, "us-ascii")
    return t.documents.select("doc_id", F.md5(parsing.decoded(data, named)).alias("digest"))


@query("select case when maildir_path = '/mail/src0/cur' then 'INBOX/cur' else regexp_extract(maildir_path, '^/mail/(.*)$', 1) end as place, count(*)::bigint as n from messages group by place", M)
def relative_path(t):
    path = F.concat(F.when(F.col("folder") == "src0", F.lit("/mail/cur")).otherwise(F.col("maildir_path")), F.lit("/"), F.col("maildir_filename"))
    return t.messages.groupBy(readers.relative_path(path, "/mail").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when doc_id % 3 = 0 then 'a=' || doc_id when doc_id % 3 = 1 then source || '=x' else source end as label, case when doc_id % 3 = 0 then 2.5::double else 1.0::double end as grade from documents")
def label_grades(t):
    i = F.col("doc_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("a="), i.cast("string"), F.lit("=2.5"))).when(i % 3 == 1, F.concat("source", F.lit("=x"))).otherwise(F.col("source"))
    label, grade = readers.label_of(said)
    return t.documents.select("doc_id", label.alias("label"), grade.alias("grade"))


@query("select folder, count(*) filter (where file_size % 97 = 0) > 0 or (count(*) filter (where last_seen_at >= timestamp '2024-01-02 00:00:00') = 0 and count(*) > 0) as vetoed from sync_state where folder is not null group by folder", S)
def deletion_vetoes(t):
    """For each folder whether a scan may delete: not after failures, and not if it has seen nothing of what is tracked."""
    seen = F.count_if(F.col("last_seen_at") >= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    rows = t.sync_state.filter("folder is not null").groupBy("folder")
    counts = rows.agg(seen.alias("seen"), F.count(F.lit(1)).alias("tracked"), F.count_if(F.col("file_size") % 97 == 0).alias("failures"))
    return counts.select("folder", ingest.vetoed(F.col("seen"), F.col("tracked"), F.col("failures")).alias("vetoed"))


BEAT = "event_type = 'signup'"
SERVICE = "case when user_id % 3 = 0 then 0 else user_id % 7 end"


@query(f"select e.event_id, b.beat, epoch(e.ts - b.ts) <= 3 * 3600 as alive from (select *, {SERVICE} as service from events where not {BEAT}) e asof left join (select {SERVICE} as service, ts, event_id as beat from events where {BEAT}) b on e.service = b.service and e.ts >= b.ts")
def last_heartbeat(t):
    """Every event with the latest heartbeat of its service at or before it; one service has a third of all."""
    rows = t.events.withColumn("service", F.expr(SERVICE))
    beats = rows.filter(BEAT).select("service", "ts", F.col("event_id").alias("beat"), F.col("ts").alias("beat_ts"))
    out = intervals.as_of(rows.filter(f"not {BEAT}").select("event_id", "service", "ts"), beats, "service", "ts", ["beat", "beat_ts"], lambda df, name: kept(t, df, name))
    age = F.col("ts").cast("timestamp").cast("double") - F.col("beat_ts").cast("timestamp").cast("double")
    return out.select("event_id", "beat", (age <= health.STALE_BEATS * 3600).alias("alive"))


SCANS = "select event_id as scan, ts as began, ts + make_interval(0, 0, 0, 0, 0, cast(10 * power(2, event_id % 14) as int), 0) as ended from {events} where event_id % 40 = 0"


@query("select scan, count(*)::bigint as files, min(message_id) as first_id, sum(file_size)::bigint as bytes from sync_state s join (select event_id as scan, ts as began, ts + to_minutes((10 * power(2, event_id % 14))::bigint) as ended from events where event_id % 40 = 0) e on s.file_mtime_utc between began and ended group by scan", S)
def files_of_scans(t):
    """Which files changed while a scan ran, for scans of ten minutes to months."""
    scans = t.spark.sql(SCANS, events=t.events)
    parts = [("files", F.lit(1).cast("long"), F.sum), ("first_id", F.col("message_id"), F.min), ("bytes", F.col("file_size"), F.sum)]
    return intervals.over_intervals(t.sync_state, scans, "file_mtime_utc", "began", "ended", "scan", parts)


@query("select folder, status, engine, month, grouping(folder, status, engine, month)::bigint as sets, count(*)::bigint as attachments, count(distinct message_id)::bigint as messages, sum(size_bytes)::bigint as bytes from (select a.message_id, folder, coalesce(extraction_status, 'pending') as status, coalesce(ocr_model, 'none') as engine, strftime(date_sent, '%Y-%m') as month, a.size_bytes from attachments a join messages m on m.id = a.message_id where deleted_at is null) group by grouping sets ((folder), (status), (engine), (folder, month), ())", A, M)
def archive_rollups(t):
    return archive.rollups(t.attachments, t.messages)


@query("select event_id, case when event_id % 7 <> 0 and (value * 1000)::bigint <= 20000 then (value * 1000)::bigint end as elapsed_ms from events")
def timed_calls(t):
    """Every event as a call in a log and, for most, a line that it has ended, read as a stream: a call with its end within 20 s.

    The log comes in files of no order. A second run goes on from the checkpoint of the first and moves the time on, by which
    calls without an end come out.
    """
    from tessera.streaming import pipelines

    root = scratch_path(t.spark, "timed")
    ms = F.expr("cast(round(value * 1000) as bigint)")
    stamp_of = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    call = F.concat(stamp_of(F.col("ts")), F.lit(" INF mcp-call search {\"id\": "), F.col("event_id").cast("string"), F.lit("}"))
    done = F.concat(stamp_of(F.col("ts") + F.expr("make_dt_interval(0, 0, 0, value)")), F.lit(" INF mcp-tool tool=search id="), F.col("event_id").cast("string"), F.lit(" elapsedMs="), ms.cast("string"))
    lines = t.events.select(F.explode(F.array(call, F.when(F.expr("event_id % 7 <> 0"), done))).alias("value")).filter("value is not null")
    lines.repartition(6, F.xxhash64("value")).write.text(f"{root}/log")

    def run() -> None:
        logs = [t.spark.readStream.option("maxFilesPerTrigger", 4).text(f"{root}/log") for _ in range(2)]
        pipelines.append_to(pipelines.timed_calls(*logs, bound="20 seconds", late="60 days"), f"{root}/out", f"{root}/checkpoint")

    run()
    last = "2030-01-01T00:00:00Z INF mcp-call search {\"id\": -1}", "2030-01-01T00:00:30Z INF mcp-tool tool=search id=-1 elapsedMs=0"
    t.spark.createDataFrame([(x,) for x in last], "value string").coalesce(1).write.mode("append").text(f"{root}/log")
    run()
    return t.spark.read.schema("id long, elapsed_ms long").parquet(f"{root}/out").filter("id >= 0").select(F.col("id").alias("event_id"), "elapsed_ms")


@query("select event_type, count(*)::bigint as n, true as median_close, true as p95_close, true as users_close from events group by event_type")
def value_sketches(t):
    """Sketches of each kind and day, stored in two steps and merged over days; how close they are is told by the exact ranks and counts."""
    log = VersionLog(t.spark, scratch_path(t.spark, "sketches"))
    rows = t.events.select("event_type", F.to_date("ts").alias("day"), "value", "user_id")
    for half in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        sketches.append(log, sketches.sketched(t.events.filter(half).select("event_type", F.to_date("ts").alias("day"), "value", "user_id"), ["event_type", "day"], "value", "user_id"), ["event_type", "day"])
    whole = sketches.merged(log.read(sketches.TABLE), ["event_type"])
    at = whole.select("event_type", "n", sketches.quantile("quantiles", 0.5).alias("m"), sketches.quantile("quantiles", 0.95).alias("p"), sketches.distinct_count("distinct").alias("users"))
    share = lambda limit: F.count_if(F.col("value") <= F.col(limit)) / F.count(F.lit(1))
    exact = rows.join(F.broadcast(at), "event_type").groupBy("event_type", "n", "users").agg(share("m").alias("m"), share("p").alias("p"), F.count_distinct("user_id").alias("exact"))
    close = lambda c, want, by: F.abs(F.col(c) - want) <= by
    tie = 2 * sketches.RANK_ERROR + 0.01  # a value that stands often is at many ranks
    return exact.select("event_type", "n", close("m", 0.5, tie).alias("median_close"), close("p", 0.95, tie).alias("p95_close"), (F.abs(F.col("users") - F.col("exact")) <= 3 * sketches.DISTINCT_ERROR * F.col("exact") + 1).alias("users_close"))
