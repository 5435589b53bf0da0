"""What Python tasks hold does not go with the size of the batches that they get."""

import hashlib
import inspect
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessera.functions import parsing as P
from tessera.operators import batch_search
from tessera.plans import text_queries, upkeep_queries
from tessera.plans.registry import QUERIES
from tessera.sources import readers


def test_a_column_function_holds_some_rows_at_a_time(spark):
    """Of a batch of 3000 rows no more are Python's values at once; nulls, bytes and lists come and go."""
    seen = P.column_of(lambda xs: [len(xs)] * len(xs), "int", F.col("id"), rows=100)
    assert {r[0] for r in spark.range(0, 3000, 1, 1).select(seen).collect()} == {100}
    rows = spark.createDataFrame([(1, b"a", "x"), (None, None, None)], "i long, b binary, s string").coalesce(1)
    out = rows.select(P.column(lambda i, b, s: [str(i), str(b), str(s)], "array<string>", "i", "b", "s").alias("v")).collect()
    assert sorted(r.v for r in out) == [["1", "b'a'", "x"], ["None", "None", "None"]]
    assert rows.filter("false").select(P.column(str, "string", "i")).collect() == []


def test_results_leave_before_the_next_rows_are_read(spark, monkeypatch):
    """A column function gives each slice's results as they are made, so a batch's are never there as a whole."""
    made, run = [], []
    monkeypatch.setattr(P.F, "arrow_udf", lambda function, returns: lambda *columns: run.append(function))
    for shared in (False, True):
        for names in (["i"], ["i", "j"]):
            P.column_of(lambda *lists: made.append(len(lists[0])) or lists[-1], "long", *names, rows=100, shared=shared)
    batch = pa.array(range(1000))
    for function, batches in ((run[0], [batch, batch]), (run[1], [(batch, batch)] * 2)):
        made.clear()
        out = function(iter(batches))
        assert len(next(out)) == 100 and made == [100]
        assert sum(map(len, out)) == 1900 and made == [100] * 20
    assert run[2](batch) == run[3](batch, batch) == batch


@pytest.mark.parametrize("name", ["extract_ooxml", "charset_ladder"])
def test_queries_over_texts_give_results_as_they_are_made(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    kinds = re.findall(r"ArrowEvalPython \[.*\], \[.*\], (\d+)", plan)
    assert kinds == [str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)]


def test_column_functions_of_one_select_share_a_process(spark):
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("s"))
    alone, shared = (rows.select(*(P.column(lambda x, k=k: [x, k], "array<string>", "s", shared=way).alias(k) for k in "ab")) for way in (False, True))
    assert alone.collect() == shared.collect() == [(([str(i), "a"]), ([str(i), "b"])) for i in range(1000)]
    plans = [df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") for df in (alone, shared)]
    assert plans == [2, 1]


def test_mail_is_parsed_some_messages_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(readers, "MESSAGES", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], ["x"])
    assert [b.num_rows for b in readers._slices([batch])] == [3, 3, 3, 1]
    docs = spark.createDataFrame([(k, f"é {{0}} {k}\n> q", "in") for k in range(200)], "doc_id long, text string, source string").coalesce(1)
    files = text_queries.mail_files(docs)
    assert "Python" not in files._jdf.queryExecution().executedPlan().toString()  # one Python stage, which parses
    assert {bytes(r.content) for r in files.collect()} == {text_queries.MAIL.format(k, k - k % 5, f"é {{0}} {k}\n> q").encode() for k in range(200)}
    assert {(r.message_id, r.body_text) for r in readers.parse_mail(files).collect()} == {(f"{k}@x.example", f"é {{0}} {k}") for k in range(200)}


def test_headers_of_parts_are_parsed_once():
    """Messages whose parts have the same headers share the parsed ones; the parts are the same."""
    P._content_header.cache_clear()
    raw = [upkeep_queries.PARTED.replace("{0}", data).encode() for data in ("YQ==", "Yg==", "")]
    assert [P.indexable_parts(x) for x in raw] == [[("a.txt", "text/plain", data)] for data in (b"a", b"b", b"")]
    said = P._content_header.cache_info()
    assert said.hits > said.misses
    assert "t.wide.documents" in inspect.getsource(upkeep_queries.attachment_bytes)


@pytest.mark.parametrize("batches", [[1200], [1, 700, 499]])
def test_scores_do_not_depend_on_batches(batches):
    """Documents are counted and scored ROWS at a time, be they in one batch or in several."""
    rng = np.random.default_rng(3)
    words = [[f"w{k}" for k in rng.integers(0, 6, rng.integers(0, 5))] for _ in range(1200)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array([len(w) for w in words], pa.int64()), pa.array(words, pa.list_(pa.string()))], ["id", "len", "terms"])
    at = np.cumsum([0, *batches])
    cut = [whole.slice(a, n) for a, n in zip(at, batches, strict=False)]
    assert max(b.num_rows for b in batch_search._slices(iter(cut))) <= batch_search.ROWS

    class Shared:
        value = (pa.array(["w1", "w2", "w9"]), np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]]))

    counted = pa.Table.from_batches(batch_search._frequencies(Shared)(iter([b.set_column(2, "terms", pa.array([[t for t in w if t in ("w1", "w2")] for w in b.column(2).to_pylist()], pa.list_(pa.string()))) for b in cut]))).to_pydict()
    assert dict(zip(counted["term"], counted["n"], strict=True)) == {-1: 1200, -2: sum(map(len, words)), 0: sum("w1" in w for w in words), 1: sum("w2" in w for w in words), 2: 0}


def test_utf8_under_no_name_or_a_latin_one_does_not_reach_python(spark, monkeypatch):
    """Of the ladder's texts only those under another name are Python's; a null text is null."""
    documents = spark.createDataFrame([(k, None if k < 3 else "é" if k < 6 else "e") for k in range(9)], "doc_id long, text string").coalesce(1)
    tables = type("Tables", (), {"documents": documents})
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    said = {r.doc_id: r.digest for r in upkeep_queries.charset_ladder(tables).collect()}
    assert said == {k: None for k in range(3)} | {3: digest("é"), 4: digest("é"), 5: None} | {k: digest("e") for k in range(6, 9)}
    monkeypatch.setattr(P, "decode_text", lambda data, name: None if data is None else "Python")
    said = {r.doc_id: r.digest for r in upkeep_queries.charset_ladder(tables).collect()}
    assert {k for k, x in said.items() if x == digest("Python")} == {4, 7}


def test_bytes_decode_alike_in_spark_and_in_python(spark):
    odd = [None, b"", b"a\0b", "é".encode(), "é".encode("latin-1"), "é".encode("utf-16"), b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xef\xbb\xbfa", b"\x81", "𝄞".encode()]
    names = [None, "", "ASCII", "Latin_1", "utf_8", "UTF-8", "windows-1252", "utf-16", "shift_jis", "no such", "latin"]
    rows = spark.createDataFrame([(i, j, data, name) for i, data in enumerate(odd) for j, name in enumerate(names)], "i int, j int, data binary, name string")
    out = rows.select("i", "j", P.decoded(F.col("data"), F.col("name")).alias("text")).collect()
    assert {(r.i, r.j): r.text for r in out} == {(i, j): P.decode_text(data, name) for i, data in enumerate(odd) for j, name in enumerate(names)}
