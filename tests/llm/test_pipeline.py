"""The pipeline against a plain version of each stage on the same documents."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.conftest import frame, words
from tests.llm.test_lines_mixing_urls import brute_lines, brute_targets
from tests.llm.test_near_dup_and_substring import brute_components
from tests.llm.test_text_models import brute_tiles
from tessera.llm import decontaminate, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, corpus):
    import random

    rng, out = random.Random(8), tmp_path_factory.mktemp("sf")
    items = [(k, words(rng, 40, 5000)) for k in range(5)]
    docs = [r for r in corpus if r[0] is not None and r[0] not in (68, 71)] + [(71, "same row")]
    docs += [(300 + i, words(rng, 40) + (" you moronic idiot " if i % 3 == 0 else " ") + words(rng, 5)) for i in range(120)]
    docs += [(500 + k, words(rng, 30) + " " + t + " " + words(rng, 30)) for k, t in items]
    docs = [(i, t, f"s{i % 4}") for i, t in docs]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, _ in docs if 300 <= i < 400]
    frame(spark, docs).drop("id", "row", "bucket", "rep", "copies").coalesce(3).write.parquet(f"{out}/documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), out / "benchmark.parquet")
    pq.write_table(pa.table({c: [r[k] for r in labels] for k, c in enumerate(("doc_id", "quality", "toxic"))}), out / "labels.parquet")
    return str(out), docs, items, labels


def plain_pipeline(docs, items, labels):
    train = sorted((y, i) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5)
    text = {i: t for i, t, _ in docs}
    model = toxicity.fit([text[i] for _, i in train], np.array([y for y, _ in train]), np.ones(len(train)))
    docs = [d for d in docs if model.score(d[1]) < 0.5]
    docs = [(i, None if t is None else kept, s) for (i, t, s), (_, _, _, kept) in zip(docs, brute_lines([d[:2] for d in docs]), strict=True)]
    comp = brute_components([d[:2] for d in docs], 5, 80)
    docs = [d for d in docs if comp.get(d[0], d[0]) == d[0]]
    tok = lambda t: decontaminate.WORD.findall((t or "").lower())
    docs = [d for d in docs if not any(brute_tiles(tok(t), tok(d[1]), 5) >= 0.5 * len(tok(t)) for _, t in items)]
    size, total = (lambda t: len((t or "").encode().split())), defaultdict(int)
    for _, t, s in docs:
        total[s] += size(t)
    target, out = brute_targets(dict(total)), Counter()
    for i, t, s in docs:
        rate = target[s] / total[s]
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
        for k in range(math.floor(rate) + (u < rate - math.floor(rate))):
            out[i, t, s, k + 1] += 1
    return out


def test_pipeline_matches_the_plain_version(spark, sf_dir):
    import corpus_pipeline

    path, docs, items, labels = sf_dir
    out = corpus_pipeline.run(spark, path)
    assert Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in out.collect()) == plain_pipeline(docs, items, labels)


def test_stages_keep_the_columns_and_clean_documents(spark, sf_dir):
    import corpus_pipeline

    path, docs, _, _ = sf_dir
    df = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes), name
        assert out.count() <= df.count()
        assert stage(spark, df.filter("false"), path).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in names


def test_near_dedup_keeps_one_row_of_null_and_repeated_ids(spark):
    import random

    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d = (words(rng, 40, 5000) for _ in range(4))
    rows = [(None, a), (None, a), (7, b), (7, b), (None, b), (3, c), (9, c), (None, c), (7, d), (None, None), (None, None), (4, "")]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).repartition(3), "")
    assert out.columns == frame(spark, rows).columns
    want = [(None, a), (7, b), (3, c), (7, d), (None, None), (None, None), (4, "")]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
