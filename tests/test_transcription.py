"""Transcription scores by bits and bounds, held to plain loops."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import parsing as P
from tessera.operators import evalkit


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def garbled(rng, text):
    return "".join(rng.choice(["", c, c, c, c, "x" + c]) for c in text)


def some_texts(rng, sizes, symbols="abcdé中"):
    for n in sizes:
        text = "".join(rng.choice(symbols) for _ in range(n))
        yield text, garbled(rng, text)
        yield text, text.replace("a", "d")
        yield text, "".join(rng.choice(symbols) for _ in range(rng.randrange(0, 150)))


def test_character_errors_are_those_of_the_whole_table(spark):
    """Lengths about the 64 cells of a word, one of many words, nulls and empty texts."""
    rng = random.Random(4)
    pairs = list(some_texts(rng, [0, 1, 2, 5, 62, 63, 64, 65, 127, 128, 129, 200, 1100]))
    rows = [(k, r, h) for k, (r, h) in enumerate(pairs)] + [(9001, None, "a"), (9002, "a", None), (9003, "", None), (9004, None, None), (9005, "", "a")]
    out = spark.createDataFrame(rows, "k int, r string, h string").select("k", evalkit.character_error(F.col("r"), F.col("h")).alias("e"))
    assert "levenshtein" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.e for r in out.collect()}
    assert got == {k: min(1.0, plain_distance(r, h) / len(r)) if r else float(bool(h)) for k, (r, h) in enumerate(pairs)} | {9001: 1.0, 9002: 1.0, 9003: None, 9004: 1.0, 9005: 1.0}


def test_word_errors_of_many_pairs_at_once(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(" ".join(r), " ".join(h)) for r, h in some_texts(rng, [0, 1, 3, 63, 64, 65, 130, 140, 1100], "abcdefgh")]
    monkeypatch.setattr(P, "SIDE_BY_SIDE", 5)
    want = [min(1.0, plain_distance(r.split(), h.split()) / len(r.split())) if r.split() else float(bool(h.split())) for r, h in pairs]
    assert P.word_error_rates(*map(list, zip(*pairs, strict=True))) == want
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate([*pairs, ("a b", "a b"), (None, "a"), ("- -", "- -")])], "k int, r string, h string")
    assert {r.k: r.e for r in rows.select("k", evalkit.word_error("r", "h").alias("e")).collect()} == dict(enumerate([*want, 0.0, 1.0, 0.0]))


def test_normalised_pages_are_those_of_a_rule_by_rule_version():
    """A page's characters are looked up once; the rules of lines and marks add nothing to it."""

    def rules(s):
        plain = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", s))
        plain = unicodedata.normalize("NFKC", re.sub(r"(?m)^\s*[-=]{3,}\s*$", " ", re.sub(r"[#*_`~>|]+", " ", plain)))
        return " ".join("".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c.isspace() else " " for c in plain).split()).lower()

    rng = random.Random(6)
    for _ in range(5000):
        s = "".join(rng.choice("abC dE\n\t-=#*_`~>|[]()!é̸̈ﬁ½ ​٣²Ω가中İ") for _ in range(rng.randrange(40)))
        assert P.ocr_normalize(s) == rules(s)
    assert all(isinstance(k, int) for k in P._COMPARED)  # a character's kind is asked for once


def test_equal_pages_are_not_counted(spark, monkeypatch):
    rows = [(1, "a b a", "a b a"), (2, "a b a", "a c"), (3, "- -", "- -"), (4, None, "a"), (5, "a", None), (6, None, None), (7, "²", "²")]
    pages = spark.createDataFrame([("x", k, 1, r, h, None) for k, r, h in rows], "engine string, attachment_id long, page int, reference string, hypothesis string, error string")
    assert {r.attachment_id: r.f1 for r in evalkit.token_f1(pages).collect()} == {1: 1.0, 2: 0.4, 4: 0.0, 5: 0.0, 7: 1.0}
    monkeypatch.setattr(P, "token_f1", None)
    assert [evalkit._f1(True, r, None) for _, r, h in rows if r == h and r] == [1.0, None, 1.0]
