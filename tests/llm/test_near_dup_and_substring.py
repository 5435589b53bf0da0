import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tessera.llm import minmax_dedup
from tessera.llm.components import connected_components
from tessera.llm.minmax_dedup import band_hashes, minmax_signature, near_duplicates, permutation_factors, shingle_set
from tessera.llm.scratch import Scratch, sift
from tessera.llm.substring_dedup import repeated_windows, window_fingerprints
from tessera.llm.words import HASH, rolling


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None and shingles(t, n):
            sets[i].append(shingles(t, n))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("ngram", "percent"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, corpus, ngram, percent):
    want = brute_components(corpus, ngram, percent)
    out = near_duplicates(frame(spark, corpus), ngram=ngram, percent=percent).collect()
    assert len(out) == len(corpus)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want.get(r.doc_id, r.doc_id)
            assert r.kept == (r.component_id == r.doc_id)
    assert any(not r.kept for r in out)


def test_chains_link_through_members_that_are_no_hub(spark):
    # each differs from the next by a few words: only a chain links the ends
    base = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(12):
        w = list(base)
        w[10 * i : 10 * i + 3] = [f"e{i}a", f"e{i}b", f"e{i}c"]
        base[10 * i : 10 * i + 3] = w[10 * i : 10 * i + 3]
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), ngram=3, percent=85).collect()}
    assert got == want


def just_below(n, seed=5):
    """Documents of one base, each pair a little under 85 % alike, but for a few pairs over it."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(300), 6):
            w[k] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    return [*rows, *((n + i, rows[7 * i][1] + " and more") for i in range(n // 20))]


def test_groups_just_below_the_threshold(spark, monkeypatch):
    rows = just_below(640)
    want = brute_components(rows, 3, 85)
    assert len(set(want.values())) > 300
    sent = []
    plain = minmax_dedup._late_rows
    monkeypatch.setattr(minmax_dedup, "_late_rows", lambda apart: sent.append(plain(apart)) or sent[0])
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), ngram=3, percent=85).collect()}
    assert got == want
    times = 1 + len(rows) * 310 // minmax_dedup.CELL
    assert sent[0].count() < 2 * times * 32 * len(rows)  # for each band at most


@pytest.mark.parametrize("cell", [200, 3000])
def test_blocks_of_any_size_find_the_same(spark, monkeypatch, cell):
    monkeypatch.setattr(minmax_dedup, "CELL", cell)
    rows = just_below(60)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), ngram=3, percent=85).collect()} == brute_components(rows, 3, 85)


def test_a_block_names_one_link_between_components():
    rng, block, sets = random.Random(1), minmax_dedup.Block(), {}
    for i in range(60):
        s = {rng.randrange(30) for _ in range(25)}
        sets[i] = np.array(sorted(s), np.uint64)
    for i in range(30):
        block.add(i, i, sets[i])
    got = {(i, j) for i in range(30, 60) for j in block.links(i, i, sets[i], 50)}
    alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 50 * len(np.union1d(x, y))
    want = {(i, j) for i in range(30, 60) for j in range(30) if alike(sets[i], sets[j])}
    assert got <= want and len(got) < len(want)

    def parts(edges):
        root = {i: i for i in range(60)}
        for a, b in sorted(edges):
            root = {k: root[a] if v == root[b] else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    assert parts(got) == parts(want)


def test_signature_keeps_both_ends_and_estimates_similarity():
    a, b = shingle_set(" ".join(f"w{i}" for i in range(1000)), 3), shingle_set(" ".join(f"w{i}" for i in range(100, 1100)), 3)
    f = permutation_factors(512)
    x, y = minmax_signature(a, f, chunk=100), minmax_signature(b, f)
    assert (x == minmax_signature(a, f)).all() and (x[:, 0] <= x[:, 1]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.05
    assert len(set(band_hashes(x, 4).tolist())) == 256


def test_empty_table(spark):
    assert near_duplicates(frame(spark, []).filter("false")).count() == 0
    assert repeated_windows(frame(spark, []).filter("false")).count() == 0


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7), (50, 40)], "a long, b long")
    got = {r.id: r.comp for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}


def test_sift_lets_all_wanted_pass(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("id")))
    wanted = rows.filter("id % 3 = 0").select(F.col("id").alias("w"))
    got = {r.id for r in sift(rows, F.col("k"), wanted, F.col("w")).collect()}
    assert {i for i in range(2000) if i % 3 == 0 and i % 7} <= got
    assert len(got) < 700 and not any(i % 7 == 0 for i in got)


def brute_windows(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[a : a + window]) for w in texts for a in range(len(w) - window + 1))
    out = []
    for w in texts:
        mark = [False] * len(w)
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                mark[a : a + window] = [True] * window
        out.append((len(w), sum(mark), hashlib.sha256(b" ".join(x for x, m in zip(w, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram"), [(35, 11), (12, 4), (5, 5)])
def test_windows_match_brute_force(spark, corpus, window, gram):
    rows = [r for r in corpus if r[0] != 68] + [(80, " ".join(["la"] * 100)), (81, "x " + " ".join(["a b c"] * 30)), (82, " ".join(f"p{i}" for i in range(40)) + " " + " ".join(f"p{i}" for i in range(40)))]
    got = repeated_windows(frame(spark, rows), window=window, gram=gram).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *x) for (i, _), x in zip(rows, brute_windows(rows, window), strict=True))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_windows_of_earlier_sessions_count(spark, tmp_path, corpus):
    """Three calls over one folder: each is cut as the last part of all texts so far would be."""
    rows, folder = [r for r in corpus if r[0] not in (68, None)], f"file://{tmp_path}/index"
    random.Random(2).shuffle(rows)
    for k in range(3):
        got = repeated_windows(frame(spark, rows[20 * k : 20 * k + 20]), batches=2, index_path=folder).collect()
        want = brute_windows(rows[: 20 * k + 20], 35)[20 * k :]
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *x) for (i, _), x in zip(rows[20 * k : 20 * k + 20], want, strict=True))
    again = repeated_windows(frame(spark, rows[:5]), index_path=folder).collect()
    assert all(r.n_removed == (r.n_words if r.n_words >= 35 else 0) for r in again)


def test_rolling_hash_tells_windows_apart():
    h = HASH.array([w.encode() for w in "a b c a b c a b d".split()])
    for k in (1, 2, 3, 5, 9):
        r = rolling(h, k)
        same = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
        assert [r[i] == r[j] for i in range(len(r)) for j in range(len(r))] == [a == b for a in same for b in same]
    assert len(rolling(h, 10)) == 0
    grams, least = window_fingerprints(h, 5, 2)
    assert least.tolist() == [min(grams[i : i + 4].tolist()) for i in range(len(h) - 4)]


def test_near_duplicates_of_documents_with_names(spark, corpus):
    """Names in the order of the numbers give the same components."""
    name = lambda i: None if i is None else f"doc-{i:06d}"
    numbered = minmax_dedup.near_duplicates(frame(spark, corpus)).collect()
    named = spark.createDataFrame([(name(i), t) for i, t in corpus], "doc_id string, text string")
    got = minmax_dedup.near_duplicates(named).collect()
    want = [(name(r.doc_id), r.n_shingles, name(r.component_id), r.kept) for r in numbered]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(not r.kept for r in got)
    small = minmax_dedup.near_duplicates(frame(spark, corpus).withColumn("doc_id", F.col("doc_id").cast("int")))
    assert small.schema["component_id"].dataType.simpleString() == "int" and sorted(map(str, small.collect())) == sorted(map(str, numbered))
