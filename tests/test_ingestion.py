"""A mail folder that changes, brought into an archive run by run, against the archive made of it at once."""

import datetime as dt
import os

import pytest

from tessera import ingestion
from tessera.archive import Archive
from tessera.sources.versions import VersionLog
from tessera.streaming.pipelines import hashing_model


def mail(n, words, parts=()):
    head = f"Message-ID: <{n}@x.example>\r\nFrom: Ann <ann{n}@x.example>\r\nSubject: Note {n}\r\nDate: Thu, 01 Jan 2026 10:00:00 +0000\r\n"
    if not parts:
        return f"{head}Content-Type: text/plain; charset=utf-8\r\n\r\n{words}\r\n".encode()
    body = "".join(f'--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename="{p}"\r\n\r\nfile {p}\r\n' for p in parts)
    return f'{head}Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\n{words}\r\n{body}--b--\r\n'.encode()


def put(root, path, content, hour=0):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(content)
    os.utime(at, (1_700_000_000 + 3600 * hour,) * 2)


def shown(archive):
    """What an archive says of its messages, whatever their numbers are."""
    names = {r.id: r.message_id for r in archive.messages.select("id", "message_id").collect()}
    rows = {(r.message_id, r.folder, r.subject, r.body_text, r.maildir_filename, r.has_attachments) for r in archive.messages.filter("deleted_at is null").collect()}
    live = {m for m, *_ in rows}
    return rows, {(names[r.message_id], r.part_index, r.filename) for r in archive.attachments.collect() if names[r.message_id] in live}, {r.message_id for r in archive.sync_state.collect()}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "mail"
    put(root, "cur/1", mail(1, "first words"))
    put(root, "Work/cur/2", mail(2, "second words", ["a.txt", "b.txt"]))
    put(root, "Work/new/3", mail(3, "third " * 60))
    put(root, "Old/cur/4", mail(4, "to be removed"))
    put(root, "cur/5", b"Subject: without an id\r\n\r\nhello")
    return root


def test_runs_over_a_changing_tree(spark, tree, tmp_path):
    root = f"file://{tmp_path}/archive"
    day = lambda d: dt.datetime(2026, 2, d, tzinfo=dt.UTC)
    first = ingestion.ingest_maildir(spark, root, str(tree), day(1))
    assert first.messages.count() == 5 and {r.folder for r in first.messages.collect()} == {"INBOX", "Work", "Old"}
    ids = {r.message_id: r.id for r in first.messages.collect()}
    done = ingestion.embed_pending(spark, root, hashing_model(16), day(1))
    assert done.messages.filter("embedded_at is null").count() == 0 and done.chunks.count() == done.chunk_embeddings.count() >= 1

    again = ingestion.ingest_maildir(spark, root, str(tree), day(2))  # nothing has changed
    assert shown(again) == shown(first) and again.messages.filter("embedded_at is null").count() == 0 and again.chunks.count() == done.chunks.count()

    put(tree, "cur/1", mail(1, "other words"), 5)  # changed in place
    os.remove(tree / "Old/cur/4")  # gone
    os.rename(tree / "Work/new/3", tree / "Work/cur/3:2,S")  # moved by its reader
    put(tree, "Work/cur/2b", mail(2, "second words", ["a.txt", "b.txt"]), 5)  # a second copy
    put(tree, "Work/cur/6", mail(6, "sixth", ["c.txt"]), 5)  # new
    third = ingestion.ingest_maildir(spark, root, str(tree), day(3))
    after = {r.message_id: r for r in third.messages.collect()}
    assert {m: r.id for m, r in after.items() if m in ids} == ids and len(after) == 6
    assert after["4@x.example"].deleted_at is not None and after["1@x.example"].body_text.strip() == "other words"
    assert after["1@x.example"].embed_epoch == 1 and after["1@x.example"].embedded_at is None and after["3@x.example"].embedded_at is not None
    assert after["3@x.example"].maildir_filename == "3:2,S" and third.chunks.filter(third.chunks.message_id == ids["3@x.example"]).count() >= 1

    at_once = ingestion.ingest_maildir(spark, f"file://{tmp_path}/other", str(tree), day(3))
    assert shown(third) == shown(at_once)
    put(tree, "Old/cur/4", mail(4, "to be removed"), 9)  # back again
    fourth = ingestion.ingest_maildir(spark, root, str(tree), day(4))
    assert fourth.messages.filter("message_id = '4@x.example' and deleted_at is null").count() == 1
    assert [r.id for r in fourth.search("sixth", "keyword").collect()] == [after["6@x.example"].id]
    assert not (tmp_path / "archive/_staging").exists() or not os.listdir(tmp_path / "archive/_staging")


def test_an_empty_tree_deletes_nothing(spark, tree, tmp_path):
    root = f"file://{tmp_path}/archive"
    ingestion.ingest_maildir(spark, root, str(tree))
    (tmp_path / "none/cur").mkdir(parents=True)
    after = ingestion.ingest_maildir(spark, root, str(tmp_path / "none"))
    assert after.messages.filter("deleted_at is null").count() == 5 and after.sync_state.count() == 5


def test_a_run_that_dies_changes_nothing(spark, tree, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/archive"
    ingestion.ingest_maildir(spark, root, str(tree))
    put(tree, "cur/9", mail(9, "ninth"))
    before = VersionLog(spark, root).snapshot()
    with monkeypatch.context() as m:
        m.setattr(VersionLog, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            ingestion.ingest_maildir(spark, root, str(tree))
    assert VersionLog(spark, root).snapshot() == before and Archive.open(spark, root).messages.count() == 5
    assert ingestion.ingest_maildir(spark, root, str(tree)).messages.count() == 6
