import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import frame, words
from tessera.llm import audio, scratch, warc
from tessera.llm.scratch import Scratch

PAGES = "page_id long, url string, html string, record_type string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], PAGES)


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 60}</p>" * (i % 9)) for i in range(300)] + [(400, None, None), (401, "http://h/\nx", ""), (402, "u", "long " * 300_000), (None, "n", "<p>page 1</p>"), (None, "m", "alone"), (500, "a", "twin"), (500, "b", "twin")]
    out = warc.round_trip(pages(spark, rows)).collect()
    assert len(out) == len(rows) and not any(r.error for r in out)
    holders = defaultdict(list)
    for i, _, h in rows:
        holders[h or ""].append(i)
    got = sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in out))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        known = [x for x in holders[h or ""] if x is not None]
        first = max(known) if known else None
        again = first is not None and i != first
        want.append((-1 if i is None else i, len(body), warc.payload_digest(body), "revisit" if again else "response", first if again else -1))
    assert got == sorted(want)


def test_archives_are_read_by_many_tasks(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "x" * 3000 + str(i)) for i in range(160)]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 30_000)
    manifest = warc.write_pages(pages(spark, rows).repartition(4), Scratch(spark, "t"))
    assert manifest.count() > 12
    full = warc.dealt(manifest).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert len(full) == manifest.count() and sum(map(bool, full)) > 6


def test_a_store_that_only_spark_writes(spark, tmp_path, monkeypatch):
    """viewfs is Hadoop's own; pyarrow does not know it."""
    rows = [(i, f"http://h/{i}", f"<p>page {i % 30}</p>" * (i % 9)) for i in range(90)]
    want = sorted(map(str, warc.round_trip(pages(spark, rows)).collect()))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: "viewfs://far/in")
    assert not warc.reachable("viewfs://far/in/x")
    assert sorted(map(str, warc.round_trip(pages(spark, rows)).collect())) == want
    manifest = warc.write_pages(pages(spark, rows), Scratch(spark, "t"))
    held = manifest.first().content
    assert len(list(warc.frames(io.BytesIO(held)))) == manifest.first().n_records
    assert warc.file_system(f"file://{tmp_path}")[1] == str(tmp_path)


def test_archives_have_a_dictionary_and_a_frame_each(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", f"<html><body>page number {i} " + words(rng, 300)) for i in range(200)]
    manifest = warc.write_pages(pages(spark, rows).coalesce(1), Scratch(spark, "t")).collect()
    assert sum(m.n_records for m in manifest) == 200
    seen = 0
    for m in manifest:
        data = open(m.path.removeprefix("file://"), "rb").read()
        assert struct.unpack("<I", data[:4])[0] == warc.DICT_MAGIC
        records = [warc.parse_record(r) for r in warc.frames(io.BytesIO(data))]
        assert len(records) == m.n_records
        seen += len(records)
    assert seen == 200
    files = spark.read.format("binaryFile").load([m.path for m in manifest])
    back = warc.read_archives(files).collect()
    assert {(warc.page_of(r.record_id), r.payload.decode()) for r in back} == {(i, h) for i, _, h in rows}


def test_archive_without_dictionary_and_raw_dictionary():
    record = warc.build_record(1, "u", b"x", None)
    plain = zstandard.ZstdCompressor().compress(record)
    assert list(warc.frames(io.BytesIO(plain * 3))) == [record] * 3
    d = zstandard.train_dictionary(2000, [f"sample {i} text ".encode() * 9 for i in range(200)])
    raw = d.as_bytes()
    packed = struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw + zstandard.ZstdCompressor(dict_data=d).compress(record)
    assert list(warc.frames(io.BytesIO(packed))) == [record]
    assert list(warc.frames(io.BytesIO(b""))) == []


@pytest.mark.parametrize("cut", [1, 3, 10])
def test_damaged_archives_are_refused(cut):
    out = io.BytesIO()
    warc.write_archive([warc.build_record(i, "u", f"payload {i}".encode() * 20, None) for i in range(100)], out)
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(out.getvalue()[:-cut])))


def test_damaged_records_are_named():
    good = warc.build_record(1, "u", b"payload", None)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type", b"WARC-Kind"), good[:-2], good + b"x", good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.WarcError):
            warc.http_payload(*warc.parse_record(bad))
    with pytest.raises(warc.WarcError):
        warc.http_payload(*warc.parse_record(good.replace(b"payload\r\n", b"pAyload\r\n")))


def test_pages_with_names(spark):
    rows = [("b/é >", "u", "twin"), ("a", "u", "twin"), ("12", "u", "<p>" * 9), (None, "u", "twin"), ("c+d %41", "u", None)]
    out = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert out == {("b/é >", "response", None), ("a", "revisit", "b/é >"), ("12", "response", None), (None, "revisit", "b/é >"), ("c+d %41", "response", None)}


def test_damage_in_archives_of_others_is_a_row(spark, tmp_path):
    """A frame with flipped bytes costs itself; what follows is read. A cut archive gives what it has and an error."""
    records = [warc.build_record(i, "u", f"payload {i}".encode() * 20, None) for i in range(30)]
    held = io.BytesIO()
    warc.write_archive(records, held)
    data = held.getvalue()
    starts = [k for k in range(len(data)) if data[k : k + 4] == struct.pack("<I", warc.FRAME_MAGIC)][-30:]
    hurt = bytearray(data)
    for k in range(starts[10] + 4, starts[11]):
        hurt[k] ^= 0x5A
    (tmp_path / "hurt").write_bytes(hurt)
    (tmp_path / "cut").write_bytes(data[: starts[20] + 9])
    (tmp_path / "junk").write_bytes(b"no archive at all" * 50)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("hurt", "cut", "junk")], "path string")
    out = warc.read_files(paths, with_payload=False).collect()
    good, bad = Counter(r.record_id for r in out if not r.error), [r for r in out if r.error]
    assert len(bad) == 3 and good == Counter([f"<urn:page:{i}>" for i in range(30) if i != 10] + [f"<urn:page:{i}>" for i in range(20)])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert Counter((r.record_id, r.error) for r in warc.read_archives(files, False).collect()) == Counter((r.record_id, r.error) for r in out)


def test_pages_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_are_stored_losslessly(spark, corpus):
    at = Scratch(spark, "t")
    out = audio.media_features(audio.store_tensors(audio.store_media(frame(spark, corpus), at), at)).collect()
    assert len(out) == len(corpus)
    want = {}
    for i, t in corpus:
        raw = (t or "").encode()
        want[i] = (len(raw), raw + b" " * ((-len(raw)) % 192 if raw else 192))
    for r in out:
        n, body = want[r.id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        assert r.media_bytes == len(body) + 44 and r.media_sha256 == hashlib.sha256(audio.wav_encode(body)).hexdigest()
    by_text = defaultdict(set)
    for r, (_, t) in zip(sorted(out, key=lambda r: (r.id is None, r.id)), sorted(corpus, key=lambda x: (x[0] is None, x[0])), strict=True):
        by_text[t or ""].add(str((r.n_frames, r.mel_mean, r.segments)))
    assert all(len(x) == 1 for x in by_text.values())
    none = audio.store_media(frame(spark, []).filter("false"), at)
    assert audio.media_features(audio.store_tensors(none, at)).count() == 0


def test_resampling_matches_upsample_filter_decimate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000).astype(np.float32)
    h = audio.lowpass().T.ravel()
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    full = np.convolve(up, h)
    got = audio.resample(x)
    shift = (audio.TAPS // 2 - 1) * audio.UP
    want = full[shift : shift + len(up)][:: audio.DOWN]
    assert len(got) == -(-len(x) * audio.UP // audio.DOWN)
    np.testing.assert_allclose(got[50:-50], want[50 : len(got) - 50], atol=2e-4)


def test_log_mel_and_hysteresis():
    t = np.arange(24_000) / 6000
    tone = (np.sin(2 * np.pi * 1000 * t) * (t > 1) * (t < 2)).astype(np.float32)
    mels = audio.log_mel(tone)
    assert mels.shape == (1 + -(-(24_000 - audio.FRAME) // audio.HOP), audio.MELS)
    (b, e), *rest = audio.segments(mels.mean(1))
    assert not rest and abs(b * audio.HOP / 6000 - 1) < 0.06 and abs(e * audio.HOP / 6000 - 2) < 0.06
    assert audio.segments(np.array([0, 2, 0.1, 0.1, 2, -9, 2])) == [(1, 5), (6, 7)]
    assert audio.segments(np.zeros(5)) == []
    assert audio.log_mel(np.zeros(1, np.float32)).shape == (1, audio.MELS)


def test_tensors_have_a_fixed_shape(spark):
    at = Scratch(spark, "t")
    stored = audio.store_tensors(audio.store_media(frame(spark, [(1, "loud and quiet " * 400), (2, "")]), at), at)
    table = audio.tensor_table(stored.select("id", "spans").toArrow())
    assert isinstance(table.schema.field("tensor").type, pa.FixedShapeTensorType)
    assert table["tensor"].combine_chunks().to_numpy_ndarray().shape[1:] == (audio.SLOTS, audio.MELS)
    assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))


def plain_features(body):
    """The whole way once more, one sample, frame and segment at a time."""
    x = [(b - 128) / 128 for b in body]
    h = audio.lowpass().T.ravel().astype(np.float64)
    n = -(-len(x) * audio.UP // audio.DOWN)
    shift = (audio.TAPS // 2 - 1) * audio.UP
    y = []
    for k in range(n):
        at = k * audio.DOWN + shift  # in the upsampled signal, where only every UP-th sample is not 0
        y.append(sum(h[j] * x[(at - j) // audio.UP] for j in range(len(h)) if (at - j) % audio.UP == 0 and 0 <= (at - j) // audio.UP < len(x)))
    frames = 1 + max(0, -(-(n - audio.FRAME) // audio.HOP))
    y += [0.0] * ((frames - 1) * audio.HOP + audio.FRAME - n)
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / (audio.FRAME - 1)) for k in range(audio.FRAME)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    mels = np.array([np.log(np.abs(turn @ (np.array(y[f * audio.HOP : f * audio.HOP + audio.FRAME]) * hann)) ** 2 @ audio.FILTERS + 1e-6) for f in range(frames)])
    energy = [sum(m) / audio.MELS for m in mels]
    mean = sum(energy) / frames
    spread = (sum((e - mean) ** 2 for e in energy) / frames) ** 0.5
    spans, begin = [], None
    for f, e in enumerate([*energy, None]):
        if begin is not None and (e is None or (e - mean) / spread < 0.0):
            spans.append((begin, f))
            begin = None
        elif begin is None and e is not None and spread >= 1e-6 and (e - mean) / spread > 0.5:
            begin = f
    out = []
    for b, e in spans:
        rows = []
        for k in range(audio.SLOTS):
            low = min(int(b + k * (e - b) / audio.SLOTS), e - 1)
            high = max(int(np.ceil(b + (k + 1) * (e - b) / audio.SLOTS)), low + 1)
            rows.append(mels[low:high].mean(0))
        out.append((b * audio.HOP / 6000, ((e - 1) * audio.HOP + audio.FRAME) / 6000, np.array(rows)))
    return mels, out


def test_whole_rows_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, n)) for k, n in enumerate((3, 40, 200, 400))] + [(9, None), (10, "aaaa" * 500 + "zzzz" * 300 + "aaaa" * 500)]
    at = Scratch(spark, "t")
    stored = audio.store_tensors(audio.store_media(frame(spark, rows), at), at)
    got = audio.media_features(stored).withColumn("feature", audio.feature_text(F.col("mel_mean"), F.col("n_frames"), F.col("segments")))
    texts = dict(rows)
    for r in got.collect():
        mels, found = plain_features(audio.padded((texts[r.id] or "").encode()))
        assert r.n_frames == len(mels) and len(r.segments) == len(found)
        np.testing.assert_allclose(r.mel_mean, mels.mean(0), atol=2e-3)
        for s, (a, b, t) in zip(r.segments, found, strict=True):
            assert (s.start_s, s.end_s) == pytest.approx((a, b))
            np.testing.assert_allclose(np.reshape(s.tensor, t.shape), t, atol=1e-2)
        whole = ",".join(str(int(np.floor(abs(x) * 100 + 0.5) * np.sign(x))) for x in np.array(r.mel_mean, np.float32).astype(float))
        assert r.feature.split("|")[:3] == [str(len(mels)), str(len(found)), whole]


def test_broken_wav_is_refused():
    good = audio.wav_encode(b"x" * 192)
    for bad in (good[:-1], b"RIFX" + good[4:], good[:36]):
        with pytest.raises((ValueError, struct.error)):
            audio.wav_decode(bad)
