"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and becomes the set of its character n-grams, hashed to 2^bits features. Feature j is present or
not, times r_j = log((p_j + a) / |p + a|) - log((q_j + a) / |q + a|) from the numbers of positive and negative training
texts that hold it. The features with the largest |r_j| sqrt(texts that hold j) are chosen and a logistic regression with
an L2 penalty is fitted on them, scaled. The model is a weight for each bucket: its size does not depend on the data.
It is fitted on at most `sample` labelled texts, whole ones, half of either class and first by a hash of their id, weighted
back to the classes' share; scoring covers every whole text. The sample is drawn from ids that documents and labels share.

Defined results: null and empty texts have no n-grams and score the prior of the model. A null or repeated id is scored
like any other row. Null labels are left out, several labels of an id count as toxic if one is;
of several texts of a labelled id that with the least hash is learnt from. Labels without two classes teach nothing and
all scores are 0; labels of two classes of which the documents have one at most are an error, unless there are no documents. Columns
other than id and text are inside row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.llm.scratch import Scratch

#: Longest piece of a text whose n-grams are hashed at once.
PIECE = 1 << 18
#: Tasks over the texts of the sample.
TASKS = 24
ORDERS = (3, 4, 5, 6, 7, 8)
_MULT = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio


def ngram_hashes(text: str | None, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of the whole text, piece by piece and order by order, with repeats."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    longest, shift = max(orders), np.uint64(64 - bits)
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE + longest - 1]
        last = at + PIECE >= len(codes)
        h = np.zeros(len(piece), np.uint64)
        for n in range(1, min(longest, len(piece)) + 1):
            h = (h[: len(piece) - n + 1] + piece[n - 1 :] + np.uint64(n)) * _MULT
            h ^= h >> np.uint64(29)
            if n in orders:
                # an n-gram belongs to the piece it starts in
                yield (((h if last else h[:PIECE]) * _MULT) >> shift).astype(np.int32)


def ngram_features(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of the whole text."""
    seen = np.zeros(1 << bits, bool)
    for buckets in ngram_hashes(text, orders, bits):
        seen[buckets] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class NgramModel:
    orders: tuple[int, ...]
    bits: int
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        used = [b[self.weights[b] != 0] for b in ngram_hashes(text, self.orders, self.bits)]
        z = self.bias + (float(self.weights[np.unique(np.concatenate(used))].sum(dtype=np.float64)) if used else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _telling(pos: np.ndarray, neg: np.ndarray, smooth: float, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The `features` most telling buckets by the weighted numbers of texts that hold them, and their ratios."""
    pos, neg = pos + smooth, neg + smooth
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    chosen = np.argsort(-np.abs(ratio) * np.sqrt(pos + neg - 2 * smooth), kind="stable")[:features]
    return chosen, ratio[chosen]


def _slots(chosen: np.ndarray, n: int) -> np.ndarray:
    slot = np.full(n, -1, np.int32)
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    return slot


def _held(text: str | None, slot: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The chosen buckets a text holds, by their place among the chosen."""
    f = slot[ngram_features(text, orders, bits)]
    return f[f >= 0]


def _regress(held: list[np.ndarray], labels: np.ndarray, sample_weight: np.ndarray, chosen: np.ndarray, scale: np.ndarray, orders: tuple[int, ...], bits: int, l2: float = 1e-3, rounds: int = 200, rate: float = 0.05) -> NgramModel:
    """Adam on the weighted logistic loss over the chosen buckets."""
    y, n = labels.astype(np.float64), len(held)
    flat, rows = np.concatenate(held), np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in held])
    sw = sample_weight / sample_weight.sum()
    w = np.zeros(len(chosen) + 1)  # the last is the bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, (w[:-1] * scale)[flat], n) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * sw
        grad = np.append(np.bincount(flat, g[rows], len(chosen)) * scale + l2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[chosen] = w[:-1] * scale
    return NgramModel(orders, bits, weights, float(w[-1]))


def fit(texts: list[str | None], labels: np.ndarray, sample_weight: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = 20, features: int = 2000, smooth: float = 1.0, **how) -> NgramModel:
    """The naive Bayes ratios, the `features` most telling buckets by them, and the regression over those."""
    pos, neg = np.zeros(1 << bits), np.zeros(1 << bits)
    for text, label, weight in zip(texts, labels, sample_weight, strict=True):
        (pos if label else neg)[ngram_features(text, orders, bits)] += weight
    chosen, scale = _telling(pos, neg, smooth, features)
    slot = _slots(chosen, 1 << bits)
    return _regress([_held(t, slot, orders, bits) for t in texts], labels, sample_weight, chosen, scale, orders, bits, **how)


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", held_out_of: int = 5) -> DataFrame:
    """(id, y) of the ids outside the held-out part, one row each."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    return known.filter(~held_out(F.col("id"), held_out_of))


def training_sample(known: DataFrame, docs: DataFrame, sample: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y, class_n): up to sample / 2 labelled ids of either class that documents have; at most `sample` rows.

    Labels of other documents, of which a label table for a larger corpus is full, take no place in the sample.
    """
    known = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    counts = known.groupBy("y").agg(F.count(F.lit(1)).alias("class_n"))
    half = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for y in (0, 1)]
    return half[0].unionByName(half[1]).join(F.broadcast(counts), "y").select("id", "y", "class_n")


def held_out(doc_id: Column, of: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == 0


def _counter(orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y, ngram_features(text.as_py(), orders, bits)] += 1
        held = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(held), 1 << 16):
            b = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(counts[1, b]), pa.array(counts[0, b])], ["bucket", "pos", "neg"])

    return run


def _holder(chosen, orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(chosen.value, 1 << bits)
        for batch in batches:
            held = [_held(t.as_py(), slot, orders, bits) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(held, pa.list_(pa.int32()))], ["y", "id", "held"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, orders: tuple[int, ...] = ORDERS, bits: int = 20, features: int = 2000, smooth: float = 1.0, **how) -> NgramModel | None:
    """The model, or None where the labels do not know two classes or there are no documents.

    Documents of which none, or only those of one class, are labelled while the labels know both are refused: their scores
    would say nothing.

    Texts stay with the executors, whole and however long: the driver gets the number of texts of either class that hold a
    bucket, and then for each text of the sample which of the chosen buckets it holds.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    known = scratch.keep(labelled(labels, id_col, label_col), "known")
    chosen = scratch.keep(training_sample(known, docs, sample, id_col), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    texts = texts.groupBy("id", "y", "class_n").agg(first).select("t.text", "y", "id", "class_n").repartition(TASKS, "id")
    texts = scratch.keep(texts, "sample")
    classes = {r.y: r for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max("class_n").alias("class_n")).collect()}
    if len(classes) < 2:
        if known.select("y").distinct().count() == 2 and not docs.isEmpty():
            raise ValueError("the labels know two classes, but not of these documents: there is nothing to learn from")
        return None
    weight = np.array([classes[y].class_n / classes[y].n for y in (0, 1)])
    counts = texts.select("text", "y").mapInArrow(_counter(orders, bits), "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg, at = np.zeros(1 << bits), np.zeros(1 << bits), counts["bucket"].to_numpy()
    pos[at], neg[at] = counts["pos"].to_numpy() * weight[1], counts["neg"].to_numpy() * weight[0]
    buckets, scale = _telling(pos, neg, smooth, features)
    kind = StructType([*texts.select("y", "id").schema.fields, StructField("held", ArrayType(IntegerType()))])
    held = texts.select("text", "y", "id").mapInArrow(_holder(spark.sparkContext.broadcast(buckets), orders, bits), kind).toArrow()
    scratch.drop(texts, known, chosen)
    y = held["y"].to_numpy()
    order = np.lexsort((held["id"].to_numpy(), y))  # the same model whatever the order of the rows
    column = held["held"]
    return _regress([np.asarray(column[int(i)].values, np.int32) for i in order], y[order], weight[y[order]], buckets, scale, orders, bits, **how)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = [m.score(t.as_py()) if m else 0.0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, carry: bool = False) -> DataFrame:
    """(id, held_out, score, predicted), with carry also row, the input row whole."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    extra = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), *extra, F.col(text_col).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    scored = rows.mapInArrow(_scorer(model), schema)
    return scored.select("id", *(["row"] if carry else []), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
