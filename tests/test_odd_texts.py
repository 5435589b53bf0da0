"""Queries whose SQL says the same of every text hold for texts that are null, empty, blank, long or hardly texts."""

import hashlib

import numpy as np

from tessera.functions import parsing as P
from tessera.plans import archive_queries, text_queries, upkeep_queries
from tessera.streaming import pipelines

ODD = [
    None, "", " ", "\n\t\n", "\xa0", "　 ", "a\xa0\nb \nc　", "﻿a﻿ b", "\0zero\0", "bell\x07 \x0b \x0c", "\x1c\x1d", "￾￿",
    "next\x85line x", "\r\n\ra\rb", "<w:t>&amp;</w:t> ]]> [x]", "[", "]", "​", "\U0010ffff \xe9",
]


def tables(spark, **rows):
    made = {name: spark.createDataFrame(list(enumerate(texts)), schema).coalesce(1) for name, (texts, schema) in rows.items()}
    return type("Tables", (), {"spark": spark} | made)


def test_every_text_comes_back_from_office_files(spark):
    long = ["x " * (P.MAX_TEXT // 2 + 9) + "end", "\xe9" * (P.MAX_TEXT + 9), "\n" * (P.MAX_ATTACHMENT // 33)]
    out = text_queries.extract_ooxml(tables(spark, documents=(ODD + long, "doc_id long, text string"))).collect()
    assert [(r.doc_id, r.status, r.same) for r in sorted(out)] == [(k, "done", True) for k in range(len(ODD + long))]


def test_a_text_that_comes_back_otherwise_is_told(spark, monkeypatch):
    """What the files are extracted to is compared, not taken for granted."""
    monkeypatch.setattr(text_queries, "through_docx", {"a b": "a  b", "cut": "cu", "": "x", "lost": None}.get)
    out = text_queries.extract_ooxml(tables(spark, documents=(["a b", "cut", "", "lost"], "doc_id long, text string"))).collect()
    assert [tuple(r) for r in sorted(out)] == [(0, "done", True), (1, "done", False), (2, "done", False), (3, "no_text", None)]


def test_every_message_of_the_queue_has_a_unit_vector(spark):
    """Also without a body, and with words that cancel each other in the hashing model."""
    by_place, cancel = {}, []
    for w in (f"w{k}" for k in range(400)):
        v = pipelines.hashing_model()([w])[0][1]
        at, sign = int(np.flatnonzero(v)[0]), int(v.sum())
        if other := by_place.get((at, -sign)):
            cancel.append(f"{other} {w}")
        by_place[at, sign] = w
    cancel += [f"document: {w}" for w in cancel]
    assert cancel and all(abs(np.linalg.norm(v) - 1) < 1e-6 for _, v in pipelines.hashing_model()(cancel))
    texts = ODD + cancel
    messages = spark.createDataFrame([(k, x, None, None) for k, x in enumerate(texts)], "id long, body_text string, deleted_at timestamp, embedded_at timestamp")
    out = archive_queries.stream_embed_queue(type("Tables", (), {"spark": spark, "messages": messages})).collect()
    assert sorted(tuple(r) for r in out) == [(k, 64, 1.0) for k in range(len(texts))]


def test_the_charset_ladder_has_every_text(spark):
    """ASCII or not, under each of its three names; only a null text has no digest."""
    texts = [x for x in [*ODD, "Stra\xdfe"] for _ in range(3)]
    out = upkeep_queries.charset_ladder(tables(spark, documents=(texts, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.digest for r in out} == {k: None if x is None else hashlib.md5(x.encode()).hexdigest() for k, x in enumerate(texts)}
