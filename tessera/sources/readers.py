"""Sources: mail folders, logs, status files, query sets, reports and versioned tables."""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.parsing import indexable_parts, parse_message
from tessera.sources.versions import current, publish  # noqa: F401  where tables are read and written

PARSED = f"message_id string, thread_id string, subject string, from_address string, from_name string, to_addresses {schemas.ADDRESS}, cc_addresses {schemas.ADDRESS}, date_sent_raw string, body_text string, body_html string, size_bytes long, content_hash string, attachments array<struct<part_index:int,filename:string,content_type:string,size_bytes:long>>"


def folder_name(path: Column, root: str) -> Column:
    """INBOX for the root's own mail, else the folder's relative path with slashes."""
    inner = F.regexp_extract(path, "^(?:file:)?/*" + re.escape(root.rstrip("/").lstrip("/")).replace("/", "/+") + "/?(.*?)/?(?:cur|new)/[^/]*$", 1)
    return F.when(inner == "", "INBOX").otherwise(inner)


def relative_path(path: Column, root: str) -> Column:
    """A message's folder below the root with its leaf, cur or new; that of the root's own mail begins with INBOX."""
    leaf = F.regexp_extract(path, "/(cur|new)/[^/]*$", 1)
    return F.when(leaf != "", F.concat_ws("/", folder_name(path, root), leaf))


#: Local files without checksum files, whose names Hadoop can't make for names with colons, as mail that has been read has.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def maildir(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, mtime, size, content) of the messages below a root; unfinished deliveries in tmp are no messages."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", **PLAIN_FILES).load(root)
    mail = files.filter(F.col("path").rlike("/(cur|new)/[^/]+$"))
    return mail.select("path", folder_name(F.regexp_replace("path", "^file:/*", "/"), root).alias("folder"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def write_files(files: DataFrame) -> None:
    """A file for each row (path, content), by the tasks; paths are of a store that pyarrow knows."""

    def run(batches):
        import pyarrow.fs

        for b in batches:
            for path, content in zip(*b.columns, strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(path.as_py())
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at, compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


#: Messages that a task holds parsed at a time.
MESSAGES = 64


def _slices(batches):
    """Batches of MESSAGES rows at most."""
    for b in batches:
        for at in range(0, b.num_rows, MESSAGES):
            yield b.slice(at, MESSAGES)


def part_bytes(files: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """(path, part_index, filename, content_type, data, error) of (path, content, part_index): one part of a message.

    A path outside root, a part that is not there and one of more than `most` bytes are errors, and data is null. Parts are
    numbered as parse_mail() does it. Dots in a path are resolved before it is held against the root.
    """

    def run(batches):
        base = posixpath.normpath(root)
        for b in _slices(batches):
            out = []
            for path, content, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                inside = posixpath.normpath(path).startswith(base + "/")
                parts = indexable_parts(content) if inside and content is not None else []
                if not inside:
                    said = (None, None, None, "outside")
                elif number is None or not 0 <= number < len(parts):
                    said = (None, None, None, "no_part")
                elif most is not None and len(parts[number][2]) > most:
                    said = (*parts[number][:2], None, "oversize")
                else:
                    said = (*parts[number], None)
                out.append((path, number, *said))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "part_index", "filename", "content_type", "data", "error"])

    rows = files.select("path", "content", F.col("part_index").cast("int").alias("part_index"))
    return rows.mapInArrow(run, "path string, part_index int, filename string, content_type string, data binary, error string")


def parse_mail(files: DataFrame) -> DataFrame:
    """Parsed messages, a batch of files at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("path string, folder string, " + PARSED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in _slices(batches):
            rows = [{"path": p.as_py(), "folder": f.as_py(), **parse_message(c.as_py())} for p, f, c in zip(*b.columns, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "folder", "content").mapInArrow(run, schema)


# The two forms of a log line that records a call, with a whole timestamp or a time of day only.
CALL = r"^(\S+) .*\bmcp-call (\w+) (\{.*\})\s*$"
TIMED = r"^\[(\d{2}:\d{2}:\d{2}) \w+\] .*\bmcp-call tool=(\w+) args=(\{.*\})\s*$"


def tool_calls(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, seconds, tool, args, and the other columns) of the log lines that record a call.

    A line with a time of day only has no ts but its seconds since midnight, to be dated by health.dated().
    """
    line = F.col(column)
    dated, timed = line.rlike(CALL), line.rlike(TIMED)
    part = lambda k: F.when(dated, F.regexp_extract(line, CALL, k)).otherwise(F.regexp_extract(line, TIMED, k))
    clock = [F.substring(part(1), at, 2).cast("int") for at in (1, 4, 7)]
    seconds = F.when(~dated, clock[0] * 3600 + clock[1] * 60 + clock[2])
    ts = F.when(dated, F.try_to_timestamp(part(1)))
    rest = [c for c in lines.columns if c != column]
    return lines.filter(dated | timed).select(*rest, ts.alias("ts"), seconds.alias("seconds"), part(2).alias("tool"), part(3).alias("args"))


END = r"^(\S+) .*\bmcp-tool tool=(\w+) id=(-?\d+) elapsedMs=([\d.]+)\s*$"


def call_ends(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, tool, id, elapsed_ms) of the log lines that record a call's end."""
    part = lambda k: F.regexp_extract(column, END, k)
    return lines.filter(F.col(column).rlike(END)).select(F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("tool"), part(3).cast("long").alias("id"), part(4).cast("double").alias("elapsed_ms"))


def call_lines(calls: DataFrame) -> DataFrame:
    """(value): the log lines of (ts, tool, args, elapsed_ms), the call and how long it took; tool_calls() reads the first."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    call = F.concat_ws(" ", ts, F.lit("INF mcp-call"), "tool", "args")
    done = F.concat(ts, F.lit(" INF mcp-tool tool="), "tool", F.lit(" elapsedMs="), F.format_string("%.1f", F.col("elapsed_ms").cast("double")))
    return calls.select(F.explode(F.array(call, done)).alias("value"))


def write_calls(calls: DataFrame, path: str) -> None:
    """Append calls to a log as text."""
    call_lines(calls).write.mode("append").text(path)


def tail(spark: SparkSession, path: str, lines: int, chunk: int = 1 << 16) -> DataFrame:
    """(value, file, back): the last lines of a log, kept in a file or in several in the order of their names; back counts from the end, from 1.

    Each task reads a file from its end, in chunks until it has enough lines, so a log of any size costs what is shown of it. Empty
    lines count; what is no UTF-8 is replaced. Hidden and checksum files are no part of a log.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", **PLAIN_FILES).load(path).select("path")

    def run(batches):
        import pyarrow.fs

        for b in batches:
            for file in b.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(file if "://" in file or file.startswith("/") else file.replace("file:", "file://", 1))
                with fs.open_input_file(at) as source:
                    end, held = source.size(), b""
                    while end and held.count(b"\n") <= lines:
                        begin = max(0, end - chunk)
                        held, end = source.read_at(end - begin, begin) + held, begin
                found = held.decode("utf-8", "replace").removesuffix("\n").split("\n")[-lines:] if held else []
                back = range(len(found), 0, -1)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([file] * len(found), pa.string()), pa.array(back, pa.int64())], ["value", "file", "at"])

    last = files.mapInArrow(run, "value string, file string, at long").orderBy(F.col("file").desc(), "at").limit(lines)
    return last.select("value", "file", F.row_number().over(Window.orderBy(F.col("file").desc(), "at")).alias("back"))  # `lines` rows


def status_of(value: Column) -> tuple[Column, Column]:
    """(finished, interval_s) of a status file's two lines; what is absent or can't be read is null."""
    line = lambda k: F.trim(F.get(F.split(value, "\n"), k))
    interval = F.when(line(1).rlike(r"^\d{1,18}$"), line(1).cast("long"))
    return F.try_to_timestamp(line(0)), interval


def status_file(lines: DataFrame) -> DataFrame:
    """(finished, interval_s) of a status file read as one text."""
    finished, interval = status_of(F.col("value"))
    return lines.agg(F.max(finished).alias("finished"), F.max(interval).alias("interval_s"))


def load_query_set(text: str) -> list[dict]:
    """A labelled query set: ids are unique, relevant messages are strings or have a grade, negatives have none."""
    out, seen = [], set()
    for q in json.loads(text)["queries"]:
        if not q.get("id") or q["id"] in seen:
            raise ValueError(f"the id {q.get('id')!r} is missing or there twice")
        seen.add(q["id"])
        gold = [{"message_id": r, "grade": 1.0} if isinstance(r, str) else {"message_id": r["messageId"], "grade": float(r.get("grade", 1))} for r in q.get("relevant") or ()]
        if bool(gold) == bool(q.get("expectEmpty")):
            raise ValueError(f"{q['id']}: either relevant messages or expectEmpty")
        f = q.get("filters") or {}
        out.append({"query_id": q["id"], "query": q.get("query") or "", "folder": f.get("folder"), "date_from": f.get("dateFrom"), "date_to": f.get("dateTo"), "from_contains": f.get("fromContains"), "from_exact": f.get("fromExact"), "expect_empty": bool(q.get("expectEmpty")), "relevant": gold})
    return out


def query_set(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([tuple(q[k] if k != "relevant" else [(r["message_id"], r["grade"]) for r in q[k]] for k in ("query_id", "query", "folder", "date_from", "date_to", "from_contains", "from_exact", "expect_empty", "relevant")) for q in load_query_set(text)], schemas.EVAL_QUERIES)


def parse_label(text: str, default: float = 1.0) -> tuple[str, float]:
    """'id=grade'; only a number after the last = is a grade."""
    head, eq, tail = text.rpartition("=")
    return (head, float(tail)) if eq and re.fullmatch(r"\d+(\.\d+)?", tail) else (text, default)


def label_of(c: Column, default: float = 1.0) -> tuple[Column, Column]:
    """parse_label() of a column: (id, grade)."""
    form = r"^(.*)=(\d+(?:\.\d+)?)$"
    graded = c.rlike(form)
    return F.when(graded, F.regexp_extract(c, form, 1)).otherwise(c), F.when(graded, F.regexp_extract(c, form, 2).cast("double")).otherwise(default)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
