"""Audio features over a media column.

A payload is stored losslessly as 8-bit mono samples in a WAV container, read back, and turned into features: polyphase
resampling (each of `up` phases of one low-pass filter is applied to every down-th window), overlapped frames, their
power spectrum through triangular mel filters, the logarithm, and segments by hysteresis: one begins where the frame
energy passes the upper bound and lasts until it falls below the lower. Each segment has its time span and one tensor
of fixed shape, its frames averaged into SLOTS rows of MELS values. A text's segments are stored as one Arrow record
batch of time spans and fixed-shape tensors in a column beside its other features, and read back from there.

A text is worked on block by block, so memory is bounded by its samples and a block.

Defined results: a null text is empty; an empty payload is one unit of padding. A null or repeated id is a row like any other.
Equal payloads have equal features. Silence, and a constant sound, has no segment. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from tessera.llm.scratch import Scratch
from tessera.llm.words import slices

UNIT, PAD, RATE = 192, b" ", 8000
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, MELS, SLOTS = 256, 96, 16, 4
BLOCK = 4096
#: How the media and tensor tables are compressed.
CODEC = "zstd"


def padded(payload: bytes) -> bytes:
    return payload + PAD * ((-len(payload)) % UNIT if payload else UNIT)


def wav_encode(samples: bytes) -> bytes:
    """8-bit mono PCM."""
    size = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size) + samples


def wav_decode(media: bytes) -> bytes:
    """The samples, with the container checked."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack("<I", media[4:8])[0] != len(media) - 8:
        raise ValueError("not a whole WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"data":
            if at + 8 + size > len(media):
                raise ValueError("the data chunk is cut off")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def lowpass() -> np.ndarray:
    """The phases (UP, TAPS) of a windowed sinc."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Rate UP / DOWN by polyphase filtering."""
    phases, n = lowpass(), -(-len(x) * UP // DOWN)
    out = np.empty(n, np.float32)
    edge = np.concatenate([np.zeros(TAPS, np.float32), x, np.zeros(TAPS + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(edge, TAPS)
    for p in range(UP):
        begin, phase = divmod(p * DOWN, UP)
        count = len(out[p::UP])
        rows = windows[begin + TAPS // 2 :: DOWN][:count]
        for b in range(0, count, BLOCK):
            out[p::UP][b : b + BLOCK] = rows[b : b + BLOCK] @ phases[phase][::-1]
    return out


def mel_filters() -> np.ndarray:
    """Triangular filters (FRAME / 2 + 1, MELS), even on the mel scale."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.arange(FRAME // 2 + 1)[:, None] * rate / FRAME
    low, mid, high = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((freq - low) / (mid - low), (high - freq) / (high - mid))).astype(np.float32)


FILTERS, WINDOW = mel_filters(), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS); the last frame is filled with zeros."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for b in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[b : b + BLOCK] * WINDOW, axis=1)
        out[b : b + BLOCK] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ FILTERS + 1e-6)
    return out


def segments(energy: np.ndarray, above: float = 0.5, below: float = 0.0) -> list[tuple[int, int]]:
    """Frame ranges that begin over mean + above deviations and end under mean + below deviations."""
    spread = float(energy.std())
    if spread < 1e-6:
        return []
    z = (energy - energy.mean()) / spread
    event = np.where(z > above, 1, np.where(z < below, 0, -1))
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(z)), -1))
    on = np.where(last >= 0, event[last], 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float, np.ndarray]]]:
    """(log-mel frames, segments as (start s, end s, tensor (SLOTS, MELS)))."""
    mels = log_mel(resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128))
    step, out = HOP / (RATE * UP / DOWN), []
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mels, 0, dtype=np.float64)])
    for b, e in segments(mels.mean(1)):
        cuts = b + np.arange(SLOTS + 1) * (e - b) / SLOTS
        low = np.minimum(cuts[:-1].astype(int), e - 1)
        high = np.maximum(np.ceil(cuts[1:]).astype(int), low + 1)
        out.append((b * step, (e - 1) * step + FRAME / (RATE * UP / DOWN), ((sums[high] - sums[low]) / (high - low)[:, None]).astype(np.float32)))
    return mels, out


def store_media(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the WAV column, written and read back."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            sizes, media = pa.array([len(r) for r in raw], pa.int64()), pa.array([wav_encode(padded(r)) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, media], ["id", "n_bytes", "media"])

    return scratch.keep(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary"), "media", CODEC)


#: What a cell of segments holds.
TENSOR = pa.fixed_shape_tensor(pa.float32(), (SLOTS, MELS), dim_names=["slot", "mel"])
SPANS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", TENSOR)])


def pack_spans(found: list[tuple[float, float, np.ndarray]]) -> bytes:
    """Segments as an Arrow record batch message; its schema is SPANS."""
    flat = np.stack([t for _, _, t in found]).ravel() if found else np.empty(0, np.float32)
    values = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), SLOTS * MELS)
    spans = [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*spans, pa.ExtensionArray.from_storage(TENSOR, values)], schema=SPANS).serialize().to_pybytes()


def unpack_spans(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(stored), SPANS)


def store_tensors(media: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, mel_mean, spans), written and read back."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "mel_mean", "spans"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            out = []
            for cell in batch.column(2):
                stored = cell.as_py()
                samples = wav_decode(stored)
                mels, found = features(samples)
                digests = hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest()
                out.append((len(samples), *digests, len(mels), mels.mean(0), pack_spans(found)))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            cols = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["id", "n_bytes", *names])

    schema = (
        f"id {media.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, n_frames long, mel_mean array<float>, spans binary"
    )
    return scratch.keep(media.select("id", "n_bytes", "media").mapInArrow(run, schema), "tensors", CODEC)


SEGMENTS = "array<struct<start_s:double,end_s:double,tensor:array<float>>>"


def media_features(stored: DataFrame) -> DataFrame:
    """The columns of store_tensors() with segments, (start_s, end_s, tensor) each, in the place of spans."""
    schema = StructType([*stored.schema.fields[:-1], StructField("segments", DataType.fromDDL(SEGMENTS))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            parts = [unpack_spans(cell.as_py()) for cell in batch.column(batch.num_columns - 1)]
            ends = pa.array(np.concatenate([[0], np.cumsum([p.num_rows for p in parts])]), pa.int32())
            each = pa.Table.from_batches(parts, SPANS).combine_chunks()
            tensor = each["tensor"].combine_chunks().storage.flatten() if each.num_rows else pa.array([], pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(each.num_rows + 1) * SLOTS * MELS, pa.int32()), tensor)
            spans = [each[k].combine_chunks() if each.num_rows else pa.array([], pa.float64()) for k in ("start_s", "end_s")]
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([*spans, lists], ["start_s", "end_s", "tensor"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found.cast(kinds[-1].type)], schema=kinds)

    return stored.mapInArrow(run, schema)


def tensor_table(rows: pa.Table) -> pa.Table:
    """One row for each segment of (id, spans): id, time span and a fixed-shape tensor (SLOTS, MELS)."""
    parts = [unpack_spans(cell) for cell in rows["spans"].to_pylist()]
    owner = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
    return pa.Table.from_batches(parts, SPANS).add_column(0, "id", rows["id"].take(pa.array(owner, pa.int64())))


def feature_text(mel_mean, n_frames, found):
    """The digest column: frames, segments, mean of the mels in hundredths and a hash of spans and tensors in hundredths."""
    whole = F.transform(mel_mean, lambda x: F.round(x * 100).cast("long"))
    milli = lambda c: F.round(c * 1000).cast("long")
    numbers = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    parts = F.transform(found, lambda s: F.concat_ws(",", milli(s["start_s"]), milli(s["end_s"]), numbers(s["tensor"])))
    return F.concat_ws("|", n_frames, F.size(found), F.array_join(whole.cast("array<string>"), ","), F.md5(F.array_join(parts, ";")))
