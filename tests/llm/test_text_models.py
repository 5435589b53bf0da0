import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import frame, words
from tessera.llm import decontaminate as D
from tessera.llm import licenses as L
from tessera.llm import toxicity as X


def brute_tiles(a, b, least):
    """Greedy string tiling as defined: the longest common unmarked run, again and again."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        ma[i : i + k], mb[j : j + k] = [True] * k, [True] * k
        total += k


def test_tiles_match_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(0, 40))] + item[5:20] + [9] + item[:8]
        tiles = D.greedy_tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        for p, t, n in tiles:
            assert item[p : p + n] == doc[t : t + n] and n >= 3
        for k in (0, 1):
            spans = sorted((x[k], x[k] + x[2]) for x in tiles)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        longest = max((n for _, _, n in tiles), default=0)
        assert longest == max((k for i in range(len(item)) for j in range(len(doc)) for k in [next((m for m in range(min(len(item) - i, len(doc) - j)) if item[i + m] != doc[j + m]), min(len(item) - i, len(doc) - j))] if k >= 3), default=0)
        assert sum(n for _, _, n in tiles) == brute_tiles(item, doc, 3)


@pytest.fixture(scope="module")
def leak_case():
    rng = random.Random(9)
    items = [(k, words(rng, 40, 5000)) for k in range(12)] + [(50, None), (51, ""), (52, "only three words"), (53, "!!")]
    rows = [(k, words(rng, 100, 5000)) for k in range(30)]
    rows += [(100 + k, words(rng, 50, 5000) + " " + t.upper().replace(" ", ",  ") + " " + words(rng, 9)) for k, t in items[:5]]
    w = items[6][1].split()
    rows += [(200, " ".join(w[20:]) + " between " + " ".join(w[:20])), (201, " ".join(w[:12])), (202, " ".join(w[:25])), (203, "so only three words here"), (204, None), (205, ""), (206, "a " * 5000), (None, items[0][1]), (207, items[1][1]), (207, items[1][1])]
    return items, rows


def test_leaks(spark, leak_case):
    items, rows = leak_case
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, id string")
    out = D.benchmark_leaks(frame(spark, rows), bench).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in out)
    assert got == sorted([(100 + k, k) for k in range(5)] + [(200, 6), (202, 6), (203, 52), (-1, 0), (207, 1), (207, 1)])
    reordered = next(r for r in out if r.doc_id == 200)
    assert reordered.n_tiles == 2 and reordered.coverage == 1.0
    kept = D.drop_leaking(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i is not None and (i, ) and i not in {100, 101, 102, 103, 104, 200, 202, 203, 207})


def test_tiles_of_repetitive_texts_need_no_pairs():
    """A word thousands of times in both would make hundreds of millions of pairs."""
    one = np.ones(20_000, np.uint64)
    assert D.greedy_tiles(one[:5000], one, 5) == [(0, 0, 5000)]
    mixed = np.where(np.arange(20_000) % 30 == 29, 2, 1).astype(np.uint64)
    tiles = D.greedy_tiles(one[:5000], mixed, 5)
    assert sum(n for _, _, n in tiles) == 5000 and tiles[:2] == [(0, 0, 29), (29, 30, 29)]
    index = D.ItemIndex(D.pa.array([1]), ["la " * 3000], 5, 0.5)
    assert [(n, m) for n, _, m in index.leaks("la " * 4000)] == [(0, 3000)]


def test_whole_leak_rows_match_brute_force(spark, leak_case):
    items, rows = leak_case
    bench = spark.createDataFrame(items, "item_id long, text string")
    tok = lambda t: D.WORD.findall((t or "").lower())
    want = []
    for i, text in rows:
        for k, said in items:
            w = tok(said)
            n = brute_tiles(w, tok(text), min(5, len(w))) if w else 0
            if w and n >= 0.5 * len(w):
                want.append((i, k, len(w), n, n / len(w)))
    got = D.benchmark_leaks(frame(spark, rows), bench).select("doc_id", "item_id", "item_words", "matched_words", "coverage").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("kind", ["string", "int", "bigint", "date"])
def test_leaks_keep_the_types_of_ids(spark, leak_case, kind):
    items, rows = leak_case
    cast = "cast(date_add(date'2024-01-01', cast(item_id as int)) as date)" if kind == "date" else f"cast(item_id as {kind})"
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"{cast} as item_id", "text")
    docs = frame(spark, rows).selectExpr("cast(doc_id as string) as doc_id", "text").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = D.benchmark_leaks(docs, bench.unionByName(bench))
        assert dict(out.dtypes)["item_id"] == kind and dict(out.dtypes)["doc_id"] == "string"
        assert out.count() == 11 and out.filter("item_id is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_leaks_in_blocks_and_empty_tables(spark, leak_case, monkeypatch):
    items, rows = leak_case
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.benchmark_leaks(frame(spark, rows), bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    assert sorted(map(str, D.benchmark_leaks(frame(spark, rows), bench).collect())) == want
    assert D.benchmark_leaks(frame(spark, rows), bench.filter("false")).count() == 0
    assert D.benchmark_leaks(frame(spark, rows).filter("false"), bench).count() == 0
    assert D.drop_leaking(frame(spark, rows), bench.filter("false")).count() == len(rows)


# --- licenses ---
def regex_of(markup):
    """The same template as a regular expression over words, each followed by a space."""
    out, depth = "", 0
    for tok in re.findall(r"\[\[|\]\]|\{\{|\}\}|\||<<\d+>>|[^\s\[\]{}|<>]+", markup):
        if tok in ("[[", "{{"):
            out += "(?:"
        elif tok == "]]":
            out += ")?"
        elif tok == "}}":
            out += ")"
        elif tok == "|":
            out += "|"
        elif tok.startswith("<<"):
            out += r"(?:[^ ]+ ){0,%s}" % tok[2:-2]
        else:
            out += re.escape(tok) + " "
    return re.compile(out)


@pytest.mark.parametrize("markup", ["a [[b", "a ]] b", "a | b", "{{a|b", "a }} b", "{{a]]", "[[a}}", "[[a|b]]", "a [ b", "x <<y>>"])
def test_broken_markup_is_refused(markup):
    with pytest.raises(ValueError):
        L.compile_template(markup)


@pytest.mark.parametrize("markup", ["a [[b [[c]]]] d", "a {{b|c d|}} e", "a <<2>> b", "[[x]] a [[b]] [[c]] d", "a {{b [[c]]|<<1>> d}} e", *L.TEMPLATES.values()])
def test_automata_accept_what_the_markup_says(markup):
    auto, pattern, rng = L.compile_template(markup), regex_of(markup), random.Random(1)
    vocabulary = [w for w in re.findall(r"[a-z0-9]+", markup)] + ["zz"]
    for _ in range(300):
        text = [rng.choice(vocabulary[:8] + ["zz"]) for _ in range(rng.randrange(1, 9))]
        joined = " ".join(text) + " "
        ends = {k for k in range(len(text) + 1) if pattern.fullmatch(" ".join(text[:k]) + (" " if k else ""))}
        assert auto.longest([w.encode() for w in text], 0) == max(ends, default=-1), joined


def test_license_scan_matches_a_plain_search(spark, corpus):
    extra = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "mit-license MIT  LICENSE", "MIT", "license mit license mit license", "Permission is hereby granted, free of charge, to any person", None, "ÄMIT License"]
    rows = [*corpus, *((200 + k, t) for k, t in enumerate(extra))]
    out = {(r.doc_id, r.n_words): r for r in L.scan_licenses(frame(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        r = out[i, len(w)]
        places = [(k, label) for p, label in L.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {i: next(r.labels for (d, _), r in out.items() if d == i) for i in range(200, 210)}
    assert labels[200] == "mit,mit-notice" and labels[201] == "gpl,gpl-3.0-notice" and labels[202] == "cc-by-nc-4.0-notice" and labels[203] == "apache,apache-2.0-notice"
    assert labels[205] == "" and labels[207] == "" and labels[209] == ""
    assert L.scan_licenses(frame(spark, []).filter("false")).count() == 0


# --- toxicity ---
def test_ngrams_cover_the_whole_text(monkeypatch):
    text = "".join(random.Random(2).choice("abcdeé ") for _ in range(2000))
    whole = X.ngram_features(text, (3, 5), 18)
    monkeypatch.setattr(X, "PIECE", 64)
    assert (X.ngram_features(text, (3, 5), 18) == whole).all()
    assert len(X.ngram_features("", (3,), 10)) == len(X.ngram_features(None, (3,), 10)) == len(X.ngram_features("ab", (3,), 10)) == 0


def test_scores(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = words(rng, 30).split()
        if bad:
            w[rng.randrange(30)] = "you" + rng.choice(["idiot", "moron"]) + rng.choice(["", "s", "ic"])
        rows.append((i, " ".join(w)))
        labels += [(i, 1, int(bad), "x")]
    labels += [(None, 1, 1, "x"), (3, 1, None, "x"), (1, 0, 0, "x")]
    rows += [(900, None), (901, ""), (902, "x"), (None, "what an idiot"), (903, "idiots " * 50_000), (5, "again five")]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = X.score_toxicity(df, lab).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str("" if r.id is None else r.id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.id is not None and r.id < 400]
    assert len(held) > 50 and np.mean([r.predicted == (r.id % 4 == 0) for r in held]) > 0.95
    assert next(r.predicted for r in out if r.id == 903) == 1 and next(r.predicted for r in out if r.id == 900) == 0
    flipped = lab.withColumn("toxic", lab.toxic.cast("int"))
    from pyspark.sql import functions as F

    flipped = flipped.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, X.score_toxicity(df, flipped).collect())) == sorted(map(str, out))  # held-out labels change nothing
    assert {r.score for r in X.score_toxicity(df, lab.filter("toxic = 1")).collect()} == {0.0}
    assert {r.score for r in X.score_toxicity(df, lab.filter("false")).collect()} == {0.0}
    assert X.score_toxicity(df.filter("false"), lab).count() == 0
    carried = X.score_toxicity(df, lab, carry=True)
    assert carried.select("row.*").columns == df.columns


def test_labels_of_other_documents(spark):
    """A label table of a larger corpus: its ids that are not here neither use up the sample nor go unnoticed."""
    rng = random.Random(8)
    rows = [(i, words(rng, 20) + (" youidiot" if i % 2 else "")) for i in range(200)]
    df = frame(spark, rows)
    own = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    other = spark.range(1000, 21_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    alone, among = (X.score_toxicity(df, lab, sample=120).collect() for lab in (own, own.union(other)))
    assert sorted(map(str, alone)) == sorted(map(str, among))
    assert sum(r.predicted == r.id % 2 for r in among) > 180 and len({r.score for r in among}) > 10
    for lab in (other, other.union(own.filter("toxic = 0"))):
        with pytest.raises(ValueError):
            X.score_toxicity(df, lab)
        assert X.score_toxicity(df.filter("false"), lab).count() == 0


def plain_buckets(text, orders, bits):
    """The n-grams' buckets with Python's integers."""
    codes, mask, out = [ord(c) for c in (text or "").lower()], 2**64 - 1, set()
    for i in range(len(codes)):
        h = 0
        for n in range(1, min(max(orders), len(codes) - i) + 1):
            h = (h + codes[i + n - 1] + n) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            if n in orders:
                out.add((h * 0x9E3779B97F4A7C15 & mask) >> (64 - bits))
    return out


def plain_fit(texts, labels, orders, bits, smooth=1.0, l2=1e-3, rounds=200, rate=0.05):
    """Ratios of counts and a logistic regression by gradient steps, one number after the other; (weights by bucket, bias)."""
    held = [plain_buckets(t, orders, bits) for t in texts]
    every = sorted(set().union(*held))
    count = {y: {b: smooth + sum(b in h for h, x in zip(held, labels, strict=True) if x == y) for b in every} for y in (0, 1)}
    empty = smooth * (2**bits - len(every))
    total = {y: sum(count[y].values()) + empty for y in (0, 1)}
    ratio = {b: math.log(count[1][b] / total[1]) - math.log(count[0][b] / total[0]) for b in every}
    w, bias = dict.fromkeys(every, 0.0), 0.0
    m, v = dict.fromkeys([*every, None], 0.0), dict.fromkeys([*every, None], 0.0)
    for t in range(1, rounds + 1):
        grad = {b: l2 * w[b] for b in every} | {None: 0.0}
        for h, y in zip(held, labels, strict=True):
            g = (1 / (1 + math.exp(-(bias + sum(w[b] * ratio[b] for b in h)))) - y) / len(labels)
            grad[None] += g
            for b in h:
                grad[b] += g * ratio[b]
        for b in grad:
            m[b], v[b] = 0.9 * m[b] + 0.1 * grad[b], 0.99 * v[b] + 0.01 * grad[b] ** 2
            step = rate * (m[b] / (1 - 0.9**t)) / (math.sqrt(v[b] / (1 - 0.99**t)) + 1e-8)
            if b is None:
                bias -= step
            else:
                w[b] -= step
    return {b: w[b] * ratio[b] for b in every}, bias


def test_scores_match_a_plain_fit(spark):
    rng, orders, bits = random.Random(7), (3, 4), 16
    texts = [words(rng, 5, 12) + (" idiot" if k % 3 == 0 else "") for k in range(24)]
    ids = [k for k in range(24) if zlib.crc32(str(k).encode()) % 5]
    weights, bias = plain_fit([texts[k] for k in ids], [int(k % 3 == 0) for k in ids], orders, bits)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(24)], "doc_id long, toxic int")
    model = X.train(frame(spark, list(enumerate(texts))), labels, orders=orders, bits=bits, features=10**6)
    assert model.bias == pytest.approx(bias, abs=1e-6)
    for text in [*texts, "unknown", "", None]:
        z = bias + sum(weights.get(b, 0.0) for b in plain_buckets(text, orders, bits))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_one_long_text_costs_no_other_row(spark):
    """A labelled text of more than 20 M characters, the only toxic one, is learnt from whole."""
    from pyspark.sql import functions as F

    rows = [(i, f"kind words number {i} here") for i in range(20)]
    df = frame(spark, rows).select("doc_id", "text").union(spark.range(1).select(F.lit(101).cast("long"), F.concat(F.repeat(F.lit("calm sea "), 2_300_000), F.lit("idiot"))))
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(101, 1)], "doc_id long, toxic int")
    assert zlib.crc32(b"101") % 5
    model = X.train(df, labels, features=10_000)
    assert model is not None and model.score("idiot") > model.score("kind words")
    texts = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    plain = X.fit([*texts, "calm sea " * 9 + "idiot"], np.array([0] * len(texts) + [1]), np.ones(len(texts) + 1), features=10_000)
    assert (model.weights == plain.weights).all() and model.bias == plain.bias


MIT_TEXT = """Copyright (c) 2020 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \u201cAS IS\u201d AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
GPL_TEXT = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
WHOLE = {
    "mit": MIT_TEXT, "bsd-2-clause": BSD_HEAD + BSD_TAIL, "bsd-3-clause": BSD_HEAD + "3. " + BSD_NAMES + BSD_TAIL,
    "bsd-4-clause": BSD_HEAD + BSD_ADS + "4. " + BSD_NAMES + BSD_TAIL, "isc": ISC_TEXT, "apache-2.0": APACHE_TEXT,
    "gpl-notice": GPL_TEXT.format("program", "", "3"), "lgpl-notice": GPL_TEXT.format("library", "Lesser ", "2.1"), "agpl-notice": GPL_TEXT.format("program", "Affero ", "3"),
    "mpl-2.0": MPL_TEXT, "unlicense": UNLICENSE_TEXT, "zlib": ZLIB_TEXT,
}


@pytest.mark.parametrize("label", WHOLE)
def test_a_changed_word_counts_as_the_markup_says(label):
    """Each word of a whole text replaced, left out and repeated, held to the markup as a regular expression."""
    scanner, pattern = L.LicenseScanner({label: L.TEMPLATES[label]}, {}), re.compile("(?:^|(?<= ))" + regex_of(L.TEMPLATES[label]).pattern)
    w = [x.decode() for x in L.license_words(WHOLE[label])]
    refused = 0
    for k in range(len(w)):
        for new in ([], ["zzz"], [w[k], w[k]]):
            text = ["before", *w[:k], *new, *w[k + 1 :], "after"]
            want = bool(pattern.search(" ".join(text) + " "))
            assert bool(scanner.scan(" ".join(text))[2]) == want, (k, new)
            refused += not want
    assert refused > 2 * len(w)


def plain_scan(text):
    """(labels, words inside a match) by regular expressions over words, all places tried."""
    w = [x.decode() for x in L.license_words(text)]
    inside, labels = set(), set()
    for label, markup in [*((label, p) for p, label in L.PHRASES.items()), *L.TEMPLATES.items()]:
        pattern = regex_of(markup)
        for p in range(len(w)):
            if pattern.match("".join(x + " " for x in w[p:])):
                end = max(k for k in range(p, len(w) + 1) if pattern.fullmatch("".join(x + " " for x in w[p:k])))
                inside |= set(range(p, end))
                labels |= {label} if end > p else set()
    return labels, len(inside), len(w)


def test_whole_rows_match_regular_expressions(spark):
    texts = [*WHOLE.values(), MIT_TEXT + "\n" + MPL_TEXT, "see the MIT License. " + ISC_TEXT, MIT_TEXT.replace("Software", "Softwares"), "mit license", "nothing here", None, GPL_TEXT.format("program", "", "3").split("This program is distributed")[0]]
    for r in L.scan_licenses(frame(spark, list(enumerate(texts)))).collect():
        labels, inside, n = plain_scan(texts[r.doc_id])
        assert r.labels == ",".join(sorted(labels))
        assert r.score == pytest.approx(inside / n if n else 0.0)


def test_licenses_need_all_their_wording():
    scanner, notices = L.LicenseScanner(), {k for k in L.TEMPLATES if k.endswith("-notice")} - set(WHOLE)
    found = lambda t: {label for _, _, label in scanner.scan(t)[2]} - notices
    for label, text in WHOLE.items():
        assert found("Before. " + text + " After.") == {label}
        assert found(text.rsplit(None, 1)[0]) == set()
    assert found(MIT_TEXT.replace("conditions:", "conditions: the Software is for non-commercial use only;")) == set()
    assert found(MIT_TEXT.split("THE SOFTWARE IS")[0]) == found(BSD_HEAD.split("1.")[0]) == found(BSD_HEAD + "3. No redistribution for a fee. " + BSD_TAIL) == set()
    assert found(ISC_TEXT.split("THE SOFTWARE IS")[0]) == found(APACHE_TEXT.split("Unless")[0]) == set()
