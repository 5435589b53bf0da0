"""Many searches in one pass: a block of queries against every message and vector.

A block is broadcast as two matrices, one of query vectors and one of how often each query has each term. Each Arrow batch
of vectors, or of the wanted tokens of documents, takes one matrix product, and a task keeps the k best of every query.
Those few rows are ranked at the end. The number of jobs does not depend on the number of queries in a block; queries beyond
BLOCK go in further blocks.

Scores are those of keyword.search() and vectors.semantic_search(), rounded alike, with ties by id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import fusion, keyword

#: Queries in one block; documents in one product.
BLOCK, ROWS = 500, 512


class Best:
    """The k least (value, key) of each query with different owners, held by one task."""

    def __init__(self, queries: int, k: int):
        self.k, none = k, np.empty(0, np.int64)
        self.held = [(np.empty(0), none, none)] * queries

    def add(self, query: int, values: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> None:
        kept = self.held[query]
        if len(kept[0]) == self.k:
            near = values <= kept[0][-1]
            if not near.any():
                return
            values, keys, owners = values[near], keys[near], owners[near]
        values, keys, owners = (np.concatenate(x) for x in zip(kept, (values, keys, owners), strict=True))
        order = np.lexsort((keys, values))
        first = np.sort(np.unique(owners[order], return_index=True)[1])[: self.k]
        self.held[query] = tuple(x[order][first] for x in (values, keys, owners))

    def batch(self, names: Sequence[str]) -> pa.RecordBatch:
        queries = np.repeat(np.arange(len(self.held)), [len(h[0]) for h in self.held])
        values, keys, owners = (np.concatenate([h[j] for h in self.held]) if self.held else np.empty(0) for j in range(3))
        columns = [pa.array(queries, pa.int32()), pa.array(values, pa.float64()), pa.array(keys, pa.int64()), pa.array(owners, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)


def _ranked(rows: DataFrame, names: list[str], k: int, order: list[str], rank: str) -> DataFrame:
    """Rows of a block with query_id and rank, the k best of each query."""
    named = F.element_at(F.array(*map(F.lit, names)), F.col("query") + 1).alias("query_id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn(rank, place).filter(F.col(rank) <= k).select(named, *(c for c in rows.columns if c != "query"), rank)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, so that what a task makes of one does not go with the batches that it gets."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- vectors ---
def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which cells are vectors of the width, those as rows of doubles)."""
    fits = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), width), False)
    flat = column.filter(fits).flatten().cast(pa.float64())
    return fits.to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(shared, k: int):
    """(id, message_id, embedding) -> (query, distance, chunk_id, message_id): each message by its nearest chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        squares, best = (queries**2).sum(1), Best(len(queries), k)
        for batch in _slices(batches):
            fits, vectors = _matrix(batch.column(2), queries.shape[1])
            ids, messages = (batch.column(j).filter(pa.array(fits)).to_numpy() for j in (0, 1))
            away = (vectors**2).sum(1)[:, None] + squares - 2 * vectors @ queries.T
            away = np.round(np.sqrt(np.maximum(away, 0)), 6)
            for q in range(len(queries)):
                best.add(q, away[:, q], ids, messages)
        yield best.batch(["query", "distance", "chunk_id", "message_id"])

    return run


def semantic_block(chunks: DataFrame, messages: DataFrame, queries: dict[str, Sequence[float]], k: int) -> DataFrame:
    """(query_id, distance, chunk_id, message_id, vec_rank) of the k nearest of `messages` to each query vector."""
    kept = chunks.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi").select("id", "message_id", "embedding")
    kept = kept.filter("id is not null and message_id is not null")
    parts = []
    for some in batched(queries.items(), BLOCK):
        matrix = chunks.sparkSession.sparkContext.broadcast(np.array([v for _, v in some], np.float64))
        rows = kept.mapInArrow(_nearest(matrix, k), "query int, distance double, chunk_id long, message_id long")
        rows = rows.groupBy("query", "message_id").agg(F.min(F.struct("distance", "chunk_id")).alias("b")).select("query", "b.distance", "b.chunk_id", "message_id")
        parts.append(_ranked(rows, [n for n, _ in some], k, ["distance", "chunk_id"], "vec_rank"))
    return _union(parts)


# --- words ---
def plain_words(tree) -> list[str] | None:
    """The terms of a query that is any of its words, with repeats; None for an expression."""
    phrases = [tree] if isinstance(tree, keyword.Phrase) else list(tree.parts) if isinstance(tree, keyword.Op) and tree.kind == "OR" else [None]
    simple = all(isinstance(p, keyword.Phrase) and len(p.terms) == 1 and not p.prefix and not p.anchored and p.fields == keyword.FIELDS for p in phrases)
    return [p.terms[0] for p in phrases] if simple else None


def _token_rows(docs: DataFrame | None, wanted: list[str], index, analyser: str) -> DataFrame:
    """(id, len, terms): of every document scanned, or of those with any when indexed, the wanted tokens as often as they stand."""
    if index is not None:
        found = index.postings.filter(F.col("term").isin(wanted))
        return found.groupBy("id").agg(F.max("len").alias("len"), F.collect_list("term").alias("terms"))
    have = [f for f in keyword.FIELDS if f in docs.columns]
    cut = docs.select("id", F.flatten(F.array(*(keyword.tokens(F.coalesce(F.col(f), F.lit("")), analyser) for f in have))).alias("t"))
    if analyser == "porter":
        return cut.select("id", F.size("t").cast("long").alias("len"), F.filter("t", lambda x: x.isin(wanted)).alias("terms"))
    bound = F.transform(F.array(F.struct("t")), lambda x: F.struct(F.size(x["t"]).cast("long").alias("len"), F.filter(x["t"], lambda w: w.isin(wanted)).alias("terms")))
    return cut.select("id", F.inline(bound))


def _counts(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of a batch (id, len, terms)."""
    cell = batch.column(2)
    rows = pa.compute.list_parent_indices(cell).to_numpy()
    codes = pa.compute.index_in(cell.flatten(), terms).to_numpy(zero_copy_only=False)
    keys, tf = np.unique(rows.astype(np.int64) * len(terms) + codes.astype(np.int64), return_counts=True)
    return keys // len(terms), keys % len(terms), tf


def _frequencies(shared):
    """(term, n): how many documents have each term; under -1 how many there are, under -2 how many tokens they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, docs, length = shared.value[0], 0, 0
        df = np.zeros(len(terms), np.int64)
        for batch in _slices(batches):
            docs, length = docs + batch.num_rows, length + (pa.compute.sum(batch.column(1)).as_py() or 0)
            np.add.at(df, _counts(batch, terms)[1], 1)
        numbers = np.concatenate([[-1, -2], np.arange(len(terms))])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(np.concatenate([[docs, length], df]), pa.int64())], ["term", "n"])

    return run


def _scored(shared, idf: np.ndarray, avglen: float, k: int):
    """(id, len, terms) -> (query, score, id, owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, often = shared.value
        best = Best(often.shape[1], k)
        for batch in _slices(batches):
            row, term, tf = _counts(batch, terms)
            ids, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            dense = np.zeros((batch.num_rows, len(terms)))
            dense[row, term] = idf[term] * (tf * (keyword.K1 + 1)) / (tf + keyword.K1 * (1 - keyword.B + keyword.B * length[row] / avglen))
            scores = dense @ often
            for q in range(often.shape[1]):
                hit = np.flatnonzero(scores[:, q])
                best.add(q, np.round(-scores[hit, q], 9), ids[hit], ids[hit])
        yield best.batch(["query", "score", "id", "owner"])

    return run


def keyword_block(docs: DataFrame | None, queries: dict[str, object], k: int, keep: DataFrame | None = None, index=None, analyser: str = "plain") -> DataFrame:
    """(query_id, score, id, kw_rank) of the k best documents of each query; queries are parsed trees.

    Expressions, which one product can't judge, are searched one by one.
    """
    spark = (docs if docs is not None else index.postings).sparkSession
    worded = {n: w for n, tree in queries.items() if tree is not None and (w := plain_words(tree))}
    parts = []
    for some in batched(worded.items(), BLOCK):
        wanted = sorted({t for _, words in some for t in words})
        code, often = {t: c for c, t in enumerate(wanted)}, np.zeros((len(wanted), len(some)))
        for q, (_, words) in enumerate(some):
            for t, n in Counter(words).items():
                often[code[t], q] = n
        shared = spark.sparkContext.broadcast((pa.array(wanted, pa.string()), often))
        rows = _token_rows(docs, wanted, index, analyser if index is None else index.analyser)
        said = {r.term: r.n for r in rows.mapInArrow(_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, avglen = (said.get(-1, 0), said.get(-2, 0) / max(said.get(-1, 0), 1)) if index is None else (index.n, index.avglen)
        df = np.array([said.get(c, 0) for c in range(len(wanted))], np.float64)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        if keep is not None:
            rows = rows.join(keep.select("id"), "id", "left_semi")
        best = rows.mapInArrow(_scored(shared, np.where(idf > 0, idf, keyword.LEAST_IDF), avglen or 1.0, k), "query int, score double, id long, owner long").drop("owner")
        parts.append(_ranked(best, [name for name, _ in some], k, ["score", "id"], "kw_rank"))
    for name, tree in queries.items():
        if tree is not None and name not in worded:
            hits = keyword.search(docs, tree, k, keep, index, analyser)
            parts.append(_ranked(hits.withColumn("query", F.lit(0)), [name], k, ["score", "id"], "kw_rank").select("query_id", "score", "id", "kw_rank"))
    return _union(parts) if parts else spark.createDataFrame([], "query_id string, score double, id long, kw_rank int")


def hybrid_block(kw: DataFrame, vec: DataFrame, k: int) -> DataFrame:
    """(query_id, id, kw_rank, vec_rank, chunk_id, score, rank) from the two legs, fused as fusion.fuse() does."""
    part = lambda c: F.coalesce(1.0 / (fusion.RRF_K + F.col(c)), F.lit(0.0))
    near = vec.select("query_id", F.col("message_id").alias("id"), "vec_rank", "chunk_id")
    both = kw.select("query_id", "id", "kw_rank").join(near, ["query_id", "id"], "full").withColumn("score", F.round(part("kw_rank") + part("vec_rank"), 12))
    order = [F.col("score").desc(), F.col("kw_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last(), F.col("id")]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def containing(docs: DataFrame, texts: dict[str, str], column: str = "body_text") -> DataFrame:
    """(query_id, id) of the documents that hold a text as it stands; the texts are one block, held against all rows."""
    items = docs.sparkSession.sparkContext.broadcast([(n, t) for n, t in texts.items() if t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, r) for r, cell in enumerate(batch.column(1)) if (whole := cell.as_py()) for n, t in items.value if t in whole]
            ids = batch.column(0).take(pa.array([r for _, r in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), ids], ["query_id", "id"])

    return docs.select("id", column).mapInArrow(run, "query_id string, id long")
