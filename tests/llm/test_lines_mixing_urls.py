import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tessera.llm import line_dedup, mixing, urlfilter
from tessera.llm.line_dedup import LineIndex, dedup_lines
from tessera.llm.scratch import Folder, Scratch

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(list)
    for i, t in rows:
        if i is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                holders[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_lines_match_brute_force(spark, corpus, batches):
    rows = [*corpus, (90, "short\nA LINE that many documents share \x0b"), (91, "É A LINE THAT MANY DOCUMENTS SHARE")]
    out = dedup_lines(frame(spark, rows), batches=batches)
    assert Counter((r.id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == Counter(brute_lines(rows))
    assert out.select("row.id", "row.copies").first() == (7, 2)


def test_line_index_is_incremental(spark):
    index = LineIndex(Scratch(spark, "t"), 3)
    for b in range(7):
        index.ingest(spark.createDataFrame([(b * 10 + i, h, h) for i in range(2) for h in (1, b)], "id long, h1 long, h2 long"))
    got = {r.h1: r.last for r in index.repeated().collect()}
    assert got == {1: 61} and sum(map(len, index.runs.levels)) <= 3


def test_runs_outlive_the_session(spark, tmp_path):
    """Batches of lines by two openings of one folder, against all at once; compaction goes on where it stood."""
    rng, folder = random.Random(3), f"file://{tmp_path}/index"
    rows = [(i, "\n".join(f"a line of some length {rng.randrange(40)}" for _ in range(rng.randrange(4)))) for i in range(90)]
    for k in range(3):
        got = dedup_lines(frame(spark, rows[30 * k : 30 * k + 30]), batches=2, index_path=folder).collect()
        want = brute_lines(rows[: 30 * k + 30])[30 * k :]
        assert Counter((r.id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == Counter(want)
    index = LineIndex(Folder(spark, folder), 3).runs
    assert index.version == 6 and [len(x) for x in index.levels] == [0, 1, 1]
    assert len(Folder(spark, folder).names("")) < 8  # runs that were compacted away are deleted
    broken = tmp_path / "index" / "manifest" / "000007"
    broken.mkdir()
    assert LineIndex(Folder(spark, folder), 3).runs.version == 6


def test_lines_cost_in_proportion_to_a_text(spark):
    long = "\n".join(f"one of very many lines {k}" for k in range(300_000))
    began = time.perf_counter()
    more = "\nand another line that no one has"
    rows = [(1, long), (2, long), (3, long + more)]
    out = dedup_lines(frame(spark, rows)).select("id", "n_lines", "n_dropped", F.length("kept_text").alias("n")).collect()
    assert sorted(map(tuple, out)) == [(1, 300_000, 300_000, 0), (2, 300_000, 300_000, 0), (3, 300_001, 0, len(long) + len(more))]
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("hot", [1, 2048])
def test_hot_lines_come_from_the_runs(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = [(i, "a line that every text holds\n" + f"a line of {i % 70} texts or so") for i in range(200)]
    out = dedup_lines(frame(spark, rows), batches=3).collect()
    assert Counter((r.id, r.n_lines, r.n_dropped, r.kept_text) for r in out) == Counter(brute_lines(rows))


def test_lines_empty_table(spark):
    assert dedup_lines(frame(spark, []).filter("false")).count() == 0


def brute_targets(sizes):
    """By the rule as stated: share by weight, stop at the limit, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = dict(zip(order, ((5, 2, 1)[k % 3] for k in range(len(order))), strict=True))
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + left * w[s] / total >= 2 * sizes[s] - 1e-9}
        if not full:
            for s in open_:
                target[s] += left * w[s] / total
            break
        for s in open_:
            target[s] += left * w[s] / total
        left = sum(target[s] - 2 * sizes[s] for s in full)
        for s in full:
            target[s] = 2.0 * sizes[s]
        open_ -= full
    return target


def test_mixing_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), f"s{i % 7}" if i % 11 else None) for i in range(700)] + [(800, None, "zz"), (801, "", "zz"), (802, "a\x0bb\u00a0c", "\U0001f600"), (803, "x", "\uffee"), (None, "null id", "s1")]
    df = frame(spark, rows)
    out = mixing.mix_sources(df).collect()
    sizes = defaultdict(int)
    count = lambda t: len((t or "").encode().split())
    for _, t, s in rows:
        sizes[s] += count(t)
    want = brute_targets(dict(sizes))
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        s = r.row.source
        assert r.size == count(r.row.text) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], abs=1e-6)
        assert r.copies in (math.floor(r.target / max(sizes[s], 1)), math.floor(r.target / max(sizes[s], 1)) + 1) and r.copies <= 2
        taken[s] += r.size * r.copies
    for s in (f"s{k}" for k in range(7)):
        assert taken[s] == pytest.approx(want[s], rel=0.2)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    emitted = mixing.emit(mixing.mix_sources(df))
    assert emitted.columns == [*df.columns, "mix_copy"] and emitted.count() == sum(r.copies for r in out)


def test_emitted_copies_clash_with_no_column(spark, tmp_path):
    df = frame(spark, [(i, "a b c", f"s{i % 3}") for i in range(30)]).withColumnsRenamed({"lang": "mix_copy", "row": "Mix_Copy_"})
    out = mixing.emit(mixing.mix_sources(df))
    assert out.columns == [*df.columns, "mix_copy__"]
    out.write.parquet(f"{tmp_path}/out")
    assert {r.mix_copy for r in out.collect()} == {"en"} and {r.mix_copy__ for r in out.collect()} == {1, 2}


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, "a b c " * (1 + i % 5), f"s{i % 41}" if i % 13 else None) for i in range(300)]
    want = mixing.mix_sources(frame(spark, rows)).collect()
    monkeypatch.setattr(mixing, "BROADCAST", 3)
    assert sorted(map(str, mixing.mix_sources(frame(spark, rows)).collect())) == sorted(map(str, want))


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix_sources(frame(spark, []).filter("false")).count() == 0
    assert [r.target for r in mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0.0, 0.0]


PAGES = "page_id long, url string, html string, host string, dst string"
LINK = '<a href="http://{}/x">'


def brute_urls(rows, rounds=8, damping=0.85):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        m = min([rest.find(c, n) for c in "?#" if rest.find(c, n) >= 0] or [len(rest)])
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:m]

    def rule(host, path):
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: (len(str(r)), len(r.host)), default=None)

    import re

    judged = [(i, *split(u), rule(*split(u)), re.findall(urlfilter.LINK, h or "")) for i, u, h in rows]
    edges = Counter((h, d.lower()) for _, h, _, _, links in judged for d in links if h and d.lower() != h)
    nodes = {h for _, h, _, _, _ in judged if h} | {x for e in edges for x in e}
    total = sum(1 for _, h, _, r, _ in judged if h and r) or 1
    t0 = {n: sum(1 for _, h, _, r, _ in judged if h == n and r and r.action == "allow") / total for n in nodes}
    d0 = {n: sum(1 for _, h, _, r, _ in judged if h == n and r and r.action == "block") / total for n in nodes}
    t, d = dict(t0), dict(d0)
    out_w, in_w = Counter(), Counter()
    for (a, b), n in edges.items():
        out_w[a] += n
        in_w[b] += n
    for _ in range(rounds if edges else 0):
        nt, nd = {n: (1 - damping) * t0[n] for n in nodes}, {n: (1 - damping) * d0[n] for n in nodes}
        for (a, b), n in edges.items():
            nt[b] += damping * t[a] * n / out_w[a]
            nd[a] += damping * d[b] * n / in_w[b]
        t, d = nt, nd
    return [(i, h, p, str(r) if r else None, r.action if r else "block" if d.get(h, 0) > t.get(h, 0) else "allow") for i, h, p, r, _ in judged]


def url_rows():
    return [
        (1, "http://Good.com/a", LINK.format("friend.org") + LINK.format("good.com")), (2, "http://x.net/es/1", None), (3, "http://bad.org/1", LINK.format("x.net") * 3),
        (4, "http://friend.org/", ""), (5, "https://www.example.com/en/1?q#f", LINK.format("FRIEND.org")), (6, "http://a.example.com/en/", None), (7, None, LINK.format("x.net")),
        (8, "no scheme", ""), (9, "http://com", ""), (10, "a://b://c/d", ""), (11, "http://net/fr/", ""), (12, "http://notexample.com/en/x", ""), (13, "HTTP://bad.org?x://y", ""),
        (13, "HTTP://bad.org?x://y", ""), (None, "http://friend.org/z#", ""), (14, "http://x.net/de/", LINK.format("bad.org")), (15, "http://sub.bad.org/", '<a href=relative>'),
    ]


@pytest.mark.parametrize("bound", [20_000, 0])
def test_urls_match_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "BROADCAST", bound)
    rows = url_rows()
    df = spark.createDataFrame([(*r, "h", "d") for r in rows], PAGES)
    got = urlfilter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter(brute_urls(rows))
    verdict = {r.host: r.verdict for r in got if r.rule is None}
    assert verdict["bad.org"] == "block" and verdict["friend.org"] == "allow"


def test_urls_match_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa

    rows = url_rows()
    pages = pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]})
    con = duckdb.connect()
    con.register("pages", pages)
    cur = con.execute(urlfilter.ORACLE)
    names = [c[0] for c in cur.description]
    assert Counter(tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in cur.fetchall()) == Counter(brute_urls(rows))


def test_urls_empty_table(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_kept_text_digest_of_nothing(spark):
    line = "x" * 30
    out = {r.id: r.kept_text for r in dedup_lines(frame(spark, [(1, line), (2, line), (3, line)])).collect()}
    assert out == {1: "", 2: "", 3: line} and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_urls_reach_hosts_more_than_eight_links_away(spark):
    chain = [f"h{k}.org" for k in range(14)]
    rows = [(k, f"http://{h}/", f'<a href="//{chain[k + 1]}/x">' if k % 2 else LINK.format(chain[k + 1])) for k, h in enumerate(chain[:-1])]
    rows += [(20, f"http://{chain[-1]}/", LINK.format("x.net")), (21, "http://x.net/es/1", ""), (22, "http://good.com/", "")]
    out = urlfilter.judge_urls(spark.createDataFrame([(*r, "h", "d") for r in rows], PAGES)).collect()
    assert {r.host: r.verdict for r in out} == dict.fromkeys(chain, "block") | {"x.net": "block", "good.com": "allow"}
    far = next(r for r in out if r.host == "h0.org")
    assert far.distrust == pytest.approx(0.5 * 0.15 * 0.85**14, rel=1e-5) and far.trust == 0


def test_rows_without_ids_are_drawn_apart(spark):
    """Equal rows of no id, or of one id: a source's taken words still come near its target, and reruns agree."""
    rows = [(None, "fifteen " * 10, "a")] * 600 + [(7, "other words " * 5, "b")] * 600 + [(8, "x " * 10, "c")] * 600
    for docs in (frame(spark, rows), frame(spark, rows).repartition(7)):
        out = mixing.mix_sources(docs).collect()
        taken, target = Counter(), {}
        for r in out:
            taken[r.row.source] += r.size * r.copies
            target[r.row.source] = r.target
            assert r.copies <= 2
        assert all(abs(taken[s] - target[s]) < 0.15 * max(target[s], 1) for s in target), (taken, target)
        said = sorted((r.row.source, r.copies) for r in out)
        assert said == sorted((r.row.source, r.copies) for r in mixing.mix_sources(docs).collect())


def test_lines_of_documents_with_names(spark):
    rows = [("b", "a line that many share here\nown 1"), ("a", "a line that many share here\nown 2"), ("c", "A line that many share here\nown 3"), (None, "a line that many share here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {"a": (2, 1, "own 2"), "b": (2, 1, "own 1"), "c": (2, 0, rows[2][1]), None: (1, 0, rows[3][1])}
