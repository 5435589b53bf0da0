"""WARC archives compressed with Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: payloads are told apart by SHA-1. Of records with equal payloads the one with the largest id is the response, the
others are revisits that refer to it; only ids and digests are shuffled for that, and the html follows once, by id. Each
task writes archives of bounded size to the shared folder under a name of its own and reports them in a manifest, which
is committed with the task: a lost task's files are in no manifest. Where the folder is in a store that only Spark can
write to, the manifest holds the archives themselves, byte for byte.

Reading: archives are dealt out to as many tasks as there are archives, READERS at most. A task streams an archive, loads
the dictionary from the skippable frame, decodes one frame after the other and checks each record's version line, its
named fields, its lengths and its payload digest.

Defined results: ids may be of any type that a string of theirs gives back. A null payload is empty; a record is held whole, so
memory is bounded by an archive and the longest html. A row whose id is null is a response unless a row with an id has its payload, then a
revisit; rows that share the largest id of a payload are all responses. Null urls are left out of the header. An empty
table gives no archive and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

# Magic numbers of the dictionary's skippable frame and of a Zstandard frame; names in records.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION, DATE = b"WARC/1.1", "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes of records in one archive; records that train its dictionary, bytes of each, and bytes of the dictionary.
ARCHIVE_BYTES, TRAIN_RECORDS, TRAIN_BYTES, DICT_BYTES = 16 << 20, 400, 8192, 16 << 10
CHUNK, READERS = 1 << 15, 50_000
#: Hadoop's names of a store that pyarrow knows by another.
STORES = {"s3a": "s3", "s3n": "s3"}


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | str | None) -> str:
    """The page's id in the record's; what a URN can't hold is escaped."""
    return f"<urn:page:{quote(str(page_id), safe='')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def build_record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None) -> bytes:
    """A response record, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    fields["WARC-Payload-Digest"] = f"sha1:{payload_digest(payload)}"
    if refers_to is not None:
        fields |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes], out: BinaryIO, level: int = 3) -> None:
    """Skippable frame with a dictionary trained on the first records, then a frame for each record."""
    dictionary = None
    try:
        samples = [r[:TRAIN_BYTES] for r in records[:TRAIN_RECORDS]]
        dictionary = zstandard.train_dictionary(max(256, min(DICT_BYTES, sum(map(len, samples)) // 10)), samples)
    except zstandard.ZstdError:
        pass  # too few or too small records for one: the format then has no dictionary frame
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    compress = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in records:
        out.write(compress.compress(r))


def frames(stream: BinaryIO, damage: Callable[[str], None] | None = None) -> Iterator[bytes]:
    """The content of each frame after the dictionary has been loaded from the leading skippable frame.

    A bad frame is an error; with `damage` that is told once for each stretch of bad frames, and reading goes on after it.
    """
    buffer, dictionary, hurt = stream.read(8), None, False
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", buffer[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, buffer = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while buffer or (buffer := stream.read(CHUNK)):
        frame, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                if damage is None:
                    raise WarcError(f"bad frame: {e}") from e
                if not hurt:
                    damage(f"bad frame: {e}")
                hurt, parts, buffer = True, None, _next_frame(stream, buffer)
                break
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = stream.read(CHUNK)
            if not buffer:
                if damage is None:
                    raise WarcError("the last frame is cut off")
                damage("the last frame is cut off")
                return
        if parts is not None:
            hurt = False
            yield b"".join(parts)


def _next_frame(stream: BinaryIO, buffer: bytes) -> bytes:
    """What follows a bad frame, from the next magic number on; empty at the end."""
    magic, buffer = struct.pack("<I", FRAME_MAGIC), buffer[1:]
    while (at := buffer.find(magic)) < 0:
        more = stream.read(CHUNK)
        if not more:
            return b""
        buffer = buffer[-3:] + more
    return buffer[at:]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of a record that keeps to the format."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise WarcError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the length differs from Content-Length")
    return fields, rest[:-4]


def http_payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(bytes of the full payload, the payload or None for a revisit); the digest is verified where there is a payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no HTTP header")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k.lower() == b"content-length"), None)
    if fields["warc-type"] == "revisit":
        if length is None or payload:
            raise WarcError("a revisit has a length and no payload")
        return length, None
    if length is not None and length != len(payload):
        raise WarcError("the payload's length differs from its header")
    if (said := fields.get("warc-payload-digest")) and said != f"sha1:{payload_digest(payload)}":
        raise WarcError("the payload's digest differs")
    return len(payload), payload


def _failed(said: str) -> tuple:
    return None, None, None, None, None, None, None, said


def _read_one(stream: BinaryIO, strict: bool = True) -> Iterator[tuple]:
    """A row for each record; unless strict also one for each stretch of bad frames, and one for an unusable dictionary."""
    said: list[str] = []
    try:
        for raw in frames(stream, None if strict else said.append):
            yield from map(_failed, said)
            said.clear()
            yield _record(raw)
    except (WarcError, zstandard.ZstdError) as e:
        if strict:
            raise
        said.append(str(e))
    yield from map(_failed, said)


def _record(raw: bytes) -> tuple:
    try:
        fields, block = parse_record(raw)
        size, payload = http_payload(fields, block)
    except WarcError as e:
        return _failed(str(e))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or payload_digest(payload or b"")
    return fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-type"], size, digest, fields.get("warc-refers-to"), payload, None


COLUMNS = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "error": pa.string()}
SCHEMA = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def _batches(rows: Iterator[tuple], with_payload: bool) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row if with_payload else (*row[:6], None, row[7]))
        size += len(row[6] or b"") if with_payload else 0
        if len(out) >= 5000 or size > ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), COLUMNS.values(), strict=True)], list(COLUMNS))
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), COLUMNS.values(), strict=True)], list(COLUMNS))


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    return pyarrow.fs.FileSystem.from_uri(f"{STORES[scheme]}:{rest}" if colon and scheme in STORES else uri)


def reachable(folder: str) -> bool:
    """Whether files can be written to a folder without Spark; makes the folder if so."""
    try:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
    except (pa.ArrowException, OSError):
        return False
    return True


def read_manifest(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives named in a manifest (path, n_records), streamed; a bad record is a row with its error.

    An archive that has other than n_records records is refused: it may be cut off between two frames. Where n_records is null,
    as of archives that others wrote, nothing is refused: what can't be read is a row with its error, and reading goes on behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n, content in zip(*batch.columns, strict=True):
                path, n = path.as_py(), n.as_py()
                if content.is_valid:
                    source = io.BytesIO(content.as_py())
                else:
                    fs, at = file_system(path)
                    source = fs.open_input_stream(at, compression=None)
                with source as stream:
                    for out in _batches(_read_one(stream, n is not None), with_payload):
                        n = n if n is None else n - out.num_rows
                        yield out
                if n:
                    raise WarcError(f"{path} has {-n:+d} records against its manifest")

    content = F.col("content") if "content" in manifest.columns else F.lit(None).cast("binary").alias("content")
    return manifest.select("path", "n_records", content).mapInArrow(run, SCHEMA)


def read_files(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives of any size given by path, streamed; damage is a row with its error."""
    named = paths.select("path", F.lit(None).cast("long").alias("n_records"))
    return read_manifest(dealt(named.withColumn("content", F.lit(None).cast("binary"))), with_payload)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives given as a binaryFile table, from any store that Spark reads; a file is a cell, so 2 GB at most.

    read_files() has no such bound, for stores that it reaches. Damage is a row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(_read_one(io.BytesIO(content.as_py()), strict=False), with_payload)

    return files.select("content").mapInArrow(run, SCHEMA)


def _writer(folder: str, as_files: bool):
    """Rows (page_id, url, html, refers_to) -> a row (path, n_records, content) for each archive; content only without files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, records, size, done = TaskContext.get(), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal records, size, done
            name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{done:04d}.warc.zst"
            held = io.BytesIO()
            write_archive(records, held)
            if as_files:
                fs, at = file_system(name)
                with fs.open_output_stream(at, compression=None) as out:
                    out.write(held.getbuffer())
            n, content = len(records), None if as_files else held.getvalue()
            records, size, done = [], 0, done + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([content], pa.binary())], ["path", "n_records", "content"])

        for batch in batches:
            for page, url, html, refers in zip(*batch.columns, strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                records.append(build_record(page.as_py(), url.as_py(), payload, refers.as_py()))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    return run


def write_pages(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive all pages; the manifest (path, n_records, content). Payloads under min_bytes are never revisits."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    digests = scratch.keep(rows.filter(F.octet_length("html") >= min_bytes).select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    first = scratch.keep(first, "first")  # so that a payload which many pages share can be split in the join
    again = digests.join(first, "digest").filter("page_id is null or page_id < first")
    again = scratch.keep(again.select("page_id", "digest", "first").distinct(), "again")
    lost = again.filter("page_id is null").count() > 0
    keyed = rows.join(again.filter("page_id is not null").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"), (F.col("page_id") == F.col("p")) & (F.unhex(F.sha1(F.col("html").cast("binary"))) == F.col("d")), "left")
    if lost:
        more = again.filter("page_id is null").select(F.col("digest").alias("d2"), F.col("first").alias("first2"))
        keyed = keyed.join(more, keyed.page_id.isNull() & (F.unhex(F.sha1(F.col("html").cast("binary"))) == F.col("d2")), "left").withColumn("first", F.coalesce("first", "first2"))
    folder = f"{scratch.path}/archives"
    writer = _writer(folder, reachable(folder))
    named = [F.col(c).cast("string").alias(c) for c in ("page_id", "first")]
    manifest = keyed.select(named[0], "url", "html", named[1]).mapInArrow(writer, "path string, n_records long, content binary")
    return scratch.keep(manifest, "manifest")


def dealt(manifest: DataFrame) -> DataFrame:
    """The manifest with its archives spread over tasks. A given number of tasks, as Spark would join so few bytes in one."""
    if not manifest.filter("content is not null").isEmpty():
        return manifest  # the archives are inside: the table's splits are the tasks
    n = max(1, min(manifest.count(), READERS))
    return manifest.select("path", "n_records").repartition(n)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages, read the archives back: (id_col, payload_bytes, payload_digest, record_type, refers_to, error)."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write_pages(pages, scratch, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    as_id = lambda c: F.when(c.startswith("<urn:page:"), F.url_decode(F.substring(c, 11, F.length(c) - 11))).cast(kind)
    back = read_manifest(dealt(manifest), with_payload=False)
    return back.select(as_id(F.col("record_id")).alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id(F.coalesce(F.col("refers_to"), F.lit(""))).alias("refers_to"), "error")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as first from p),
bits as (select *, list_transform(range(8), lambda g: ('0x' || substr(hex, (g * 5 + 1)::int, 5))::bigint) as words from d),
b32 as (select *, list_aggregate(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((words[(i // 4 + 1)::int] >> ((3 - i % 4) * 5)::int) & 31) + 1)::int, 1)), 'string_agg', '') as payload_digest from bits)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to from b32
"""
