import datetime as dt

import pytest

from tessera.archive import Archive, SpaceMismatch
from tessera.operators.filters import SearchFilters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    from tessera.sources.fixtures import table

    tables = {n: table(spark, SF, n).cache() for n in ("messages", "attachments", "chunks", "sync_state")}
    tables["metadata"] = spark.createDataFrame([("model", "m")], "key string, value string")
    return Archive(spark, tables, embed=lambda q: [1.0] + [0.0] * 63, identity={"model": "m"})


def test_modes(store, tmp_path):
    kw = store.search("the of", "keyword", limit=5).collect()
    assert [r["rank"] for r in kw] == [1, 2, 3, 4, 5] and [r.score for r in kw] == sorted(r.score for r in kw) and all("[" in r.snippet for r in kw)
    sem = store.search("anything", "semantic", limit=5).collect()
    assert [r.score for r in sem] == sorted(r.score for r in sem) and all(r.snippet.startswith("chunk ") for r in sem)
    both = store.search("the of", limit=10).collect()
    assert [r.score for r in both] == sorted((r.score for r in both), reverse=True) and {r.id for r in both} & {kw[0].id, sem[0].id}
    store.build_index(f"file://{tmp_path}")
    assert [(r.id, r.score) for r in store.search("the of", "keyword", limit=5).collect()] == [(r.id, r.score) for r in kw]
    with pytest.raises(ValueError):
        store.search("x", "psychic")


def test_filters_agree_over_modes(store):
    f = SearchFilters(folder="src3")
    member = {r.id for r in store.search("", filters=f, limit=100).collect()}
    assert member and {r.id for r in store.search("the", "keyword", f, 100).collect()} <= member and {r.id for r in store.search("x", "semantic", f, 100).collect()} <= member
    counts = {r.folder: r.n_messages for r in store.folders().collect()}
    assert counts["src3"] == len(member) and store.search("", limit=5).count() == 0


def test_space_guard(spark, store):
    other = Archive(spark, store.tables, store.embed, {"model": "another"})
    with pytest.raises(SpaceMismatch):
        other.search("x", "semantic")
    assert other.search("the", "keyword", limit=1).count() == 1


def test_reading(store):
    assert store.get_message(3).first().message_id == "3@docs" and store.get_message("3@docs").first().id == 3
    thread = store.get_thread(11, 2, 100).collect()
    assert len(thread) <= 2 and sum(len(r.body) for r in thread) <= 100
    page = store.attachment_text(6, 10, 5).first()
    assert page is None or len(page.page) <= 5


def test_upkeep(store):
    kept = store.purge(dt.datetime(2030, 1, 1))
    assert kept["messages"].filter("deleted_at is not null").count() == 0
    assert {r.check: r.state for r in store.doctor().collect()}["vectors"] == "ok" and store.status().first().total == 200


def test_publish_and_open(spark, store, tmp_path):
    root = f"file://{tmp_path}/a"
    made = Archive.create(spark, root, {"messages": store.messages.limit(3)})
    assert made.messages.count() == 3 and Archive.open(spark, root).chunks.count() == 0


def test_evaluation(store):
    qs = [{"query_id": "a", "query": "the", "relevant": [{"message_id": store.search("the", "keyword", limit=1).first().message_id, "grade": 1.0}]}, {"query_id": "b", "query": "nowhere0", "relevant": []}]
    out = store.evaluate(qs, "keyword", 5)
    assert out["ndcg"].first().ndcg == 1.0 and out["mrr"].first().mrr == 1.0 and out["recall"].first().recall == 1.0


@pytest.mark.parametrize("mode", ["keyword", "semantic", "hybrid"])
def test_many_queries_rank_as_each_alone(store, mode, monkeypatch):
    """Blocks of two queries, expressions, filters and an empty query among them."""
    from tessera.operators import batch_search

    monkeypatch.setattr(batch_search, "BLOCK", 2)
    said = ["the of", "the the nere onble", "of AND the", "nowhere0", "", "onble"]
    qs = [{"query_id": f"q{i}", "query": q, "relevant": [{"message_id": "3@docs", "grade": 1.0}], "folder": "src3" if i in (4, 5) else None} for i, q in enumerate(said)]
    got = {(r.query_id, r.message_id, r["rank"]) for r in store.evaluate(qs, mode, 7)["ranked"].collect()}
    want = set()
    for q in qs:
        hits = store.search(q["query"], mode, SearchFilters(folder=q["folder"]), 7).collect()
        want |= {(q["query_id"], r.message_id, r["rank"]) for r in hits}
    assert got == want


def test_commands(spark, store, tmp_path, capsys):
    import json

    from tessera.__main__ import main

    root = f"file://{tmp_path}/b"
    Archive.create(spark, root, {n: store.tables[n] for n in ("messages", "attachments", "chunks", "sync_state")})

    def said(*args):
        assert main([root, *args]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert [r["rank"] for r in said("search", "the of", "--limit", "3")] == [1, 2, 3]
    assert {r["folder"] for r in said("search", "--folder", "src3", "--limit", "2")} and said("get", "3")[0]["message_id"] == "3@docs"
    assert said("thread", "11") and said("folders") and said("audit-embeddings")[0]["state"] == "ok" and said("status")[0]["total"] == 200
    deleted = said("status")[0]["deleted"]
    assert deleted and said("purge-deleted", "--days", "1")[0] == {**said("status")[0], "deleted": 0}
    (tmp_path / "mail/cur").mkdir(parents=True)
    (tmp_path / "mail/cur/1").write_bytes(b"Subject: s\r\n\r\nhello")
    assert said("ingest", str(tmp_path / "mail"))[0]["body_text"] == "hello"
