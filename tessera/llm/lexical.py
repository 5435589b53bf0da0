"""Ranked lexical search over a two-level quantised index.

A document's score for an item is a sum over the item's terms of a weight (of the term) times a saturation (of its count
and of the document's length), all in 64-bit integers. The index holds saturations twice. Its first level is a byte a
posting, the saturation's share of its bound rounded upward, so that a byte bounds the saturation from above, and the byte
below it from below. Its second level is the count itself.

1. Documents are cut into shards, one row each: their terms, and by term the places of its documents, bytes and counts.
2. A query reads the first level alone. Sums of lower bounds give each item's k best lower bounds, merged over shards
   as a tree; the least of them bounds the kth score from below.
3. Every document whose upper bound reaches that bound is scored again, exactly, from the second level. Each task keeps the
   k best of each item, ties by id, and a last ranking joins them. No document is left out but by a bound.

Postings are never shuffled: a shard is a row. Only the bounds (items times k numbers a task, 32 tasks' to one) and the
k best of each task travel. Items are taken in blocks (BLOCK_TERMS, BLOCK_ITEMS), each broadcast and held against all shards.

Defined results: a null or empty text has no terms and is in no count and no result. Texts of items with one id, the null id
included, are one item with the terms of all; an item without terms finds nothing. Documents of one id, or without one,
are documents of their own; null ids rank last among equals. No documents, or none with terms: no rows. Very long texts are
cut into pieces at the gaps between terms, and a shard holds one at least. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm.scratch import Scratch

#: Lower-cases A-Z and makes a space of every byte that no term holds.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
IN_TERM = np.frombuffer(FOLD, np.uint8) != 32
#: Documents and terms after which a shard is closed; bytes of text whose terms are listed at once.
SHARD_DOCS, SHARD_TERMS, PIECE = 4096, 1 << 18, 1 << 20
#: Terms and items in one broadcast block, about; rows of bounds that one task merges; scored rows that a task holds before it cuts them.
BLOCK_TERMS, BLOCK_ITEMS, FAN, HELD = 1 << 17, 1 << 12, 32, 1 << 20
#: The bound of a saturation and the steps it is cut into.
UNIT, STEPS = 10**6, 255
_BYTES = np.arange(STEPS + 1, dtype=np.int64)
UPPER = _BYTES * UNIT // STEPS
LOWER = np.where(_BYTES > 0, (_BYTES - 1) * UNIT // STEPS + 1, 0)


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, list by list."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + PIECE)
        end = cut if cut >= 0 else len(raw)
        yield raw[at:end].split()
        at = end


def count_terms(text: str | None) -> int:
    inside = IN_TERM[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 20 * norm)


class _Codes(dict):
    """term -> number, in the order of first sight."""

    def __missing__(self, term: bytes) -> int:
        code = self[term] = len(self)
        return code


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        sizes = [count_terms(t.as_py()) for t in batch.column(0)]
        docs += sum(n > 0 for n in sizes)
        terms += sum(sizes)
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


PARTS = {"terms": pa.binary(), "ends": pa.binary(), "places": pa.binary(), "impacts": pa.binary(), "counts": pa.binary()}


def _shard(ids: pa.Array, codes: list[np.ndarray], vocabulary: _Codes, n_docs: int, n_terms: int, kinds: pa.Schema) -> pa.RecordBatch:
    """One row: ids, norms and the postings by term, packed."""
    sizes = [len(c) for c in codes]
    norms = np.array([50 + 50 * n * n_docs // n_terms for n in sizes], np.int64)
    keys = np.concatenate(codes) << 16 | np.repeat(np.arange(len(codes)), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    place = keys & 0xFFFF
    impacts = -(-saturation(counts, norms[place]) * STEPS // UNIT)
    ends = np.searchsorted(keys >> 16, np.arange(len(vocabulary)), "right")
    packed = [b" ".join(vocabulary), *(x.tobytes() for x in (ends.astype(np.uint32), place.astype(np.uint16), impacts.astype(np.uint8), counts.astype(np.uint32)))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(f.type) for x, f in zip((ids, pa.array(norms)), kinds, strict=False)]
    return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in packed)], schema=kinds)


def _indexer(n_docs: int, n_terms: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, codes, vocabulary, size = 0, [], _Codes(), 0
            for row, text in enumerate(batch.column(1)):
                if size >= SHARD_TERMS or len(codes) >= SHARD_DOCS:
                    yield _shard(batch.column(0).slice(begin, len(codes)), codes, vocabulary, n_docs, n_terms, kinds)
                    begin, codes, vocabulary, size = row, [], _Codes(), 0
                parts = [np.fromiter(map(vocabulary.__getitem__, p), np.int64, len(p)) for p in pieces(text.as_py())]
                codes.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
                size += len(codes[-1])
            if codes:
                yield _shard(batch.column(0).slice(begin, len(codes)), codes, vocabulary, n_docs, n_terms, kinds)

    return run


@dataclass
class Block:
    """Items in one broadcast: their ids, the distinct terms of all, and each item's terms by number."""

    ids: pa.Array
    terms: pa.Array
    of: list[np.ndarray]
    weights: np.ndarray | None = None
    least: np.ndarray | None = None


class Shard:
    """The first level of one row, as far as a block's terms go."""

    def __init__(self, block: Block, terms: bytes, ends: bytes, places: bytes | None = None, impacts: bytes | None = None):
        at = pa.compute.index_in(pa.array(terms.split(b" "), pa.binary()), block.terms)
        held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        number = at.drop_null().to_numpy(zero_copy_only=False)
        self.ends = np.frombuffer(ends, np.uint32).astype(np.int64)
        self.begin, self.size = np.zeros(len(block.terms), np.int64), np.zeros(len(block.terms), np.int64)
        self.begin[number] = np.where(held > 0, self.ends[held - 1], 0)
        self.size[number] = self.ends[held] - self.begin[number]
        if places is not None:
            self.places, self.impacts = np.frombuffer(places, np.uint16), np.frombuffer(impacts, np.uint8)

    def postings(self, block: Block, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the postings of an item's terms, and the weight of each one's term."""
        of = block.of[item]
        of = of[self.size[of] > 0]
        size = self.size[of]
        at = np.repeat(self.begin[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return at, np.repeat(block.weights[of], size)

    def sums(self, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Sums by document; parts of 2^16 postings of under 2^36 each are exact in doubles."""
        out = np.zeros(n, np.int64)
        for k in range(0, len(at), 1 << 16):
            out += np.bincount(self.places[at[k : k + (1 << 16)]], values[k : k + (1 << 16)], n).astype(np.int64)
        return out


def _frequencies(shared):
    """(term, df): how many documents of the task hold each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            for terms, ends in zip(*batch.columns, strict=True):
                total += Shard(block, terms.as_py(), ends.as_py()).size
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "df"])

    return run


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, len(values) - k)[len(values) - k :]


def _lower_bounds(shared, k: int):
    """One row a task: each item's k largest lower bounds, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = np.zeros((len(block.of), k), np.int64)
        for batch in batches:
            for n, *level in zip(*batch.columns, strict=True):
                shard = Shard(block, *(x.as_py() for x in level))
                for item, mine in enumerate(best):
                    at, weight = shard.postings(block, item)
                    if len(at):
                        sums = shard.sums(at, weight * LOWER[shard.impacts[at]], n.as_py())
                        better = sums[sums > mine.min()]
                        if len(better):
                            best[item] = _largest(np.concatenate([mine, better]), k)
        yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["bounds"])

    return run


def _merger(items: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((items, k), np.int64)
        for batch in batches:
            for row in batch.column(0):
                both = np.concatenate([best, np.frombuffer(row.as_py(), np.int64).reshape(items, k)], 1)
                best = np.partition(both, k, 1)[:, k:]
        yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["bounds"])

    return run


def _cut(rows: list[pa.Table], k: int) -> list[pa.Table]:
    """The k best rows of each item."""
    table = pa.concat_tables(rows).sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
    item = table["item"].to_numpy()
    rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
    return [table.filter(pa.array(rank < k))]


def _rescorer(shared, k: int, kinds: pa.Schema):
    """Rows (id, item, item_id, score): the k best of the task among the documents whose upper bound reaches the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = shared.value, [], 0
        for batch in batches:
            for ids, norms, *level, counts in zip(*batch.columns, strict=True):
                shard, ids = Shard(block, *(x.as_py() for x in level)), ids.values
                norms, counts = norms.values.to_numpy(), np.frombuffer(counts.as_py(), np.uint32)
                for item in range(len(block.of)):
                    at, weight = shard.postings(block, item)
                    if not len(at):
                        continue
                    reach = shard.sums(at, weight * UPPER[shard.impacts[at]], len(ids)) >= max(1, block.least[item])
                    some = reach[shard.places[at]]
                    at, weight = at[some], weight[some]
                    if not len(at):
                        continue
                    exact = shard.sums(at, weight * saturation(counts[at].astype(np.int64), norms[shard.places[at]]), len(ids))
                    found = np.flatnonzero(exact)
                    columns = [ids.take(pa.array(found)), pa.array(np.full(len(found), item, np.int32)), pa.array(exact[found])]
                    held.append(pa.table(columns, ["id", "item", "score"]))
                    size += len(found)
                if size > HELD:
                    held = _cut(held, k)
                    size = held[0].num_rows
        if held:
            for part in _cut(held, k)[0].combine_chunks().to_batches():
                item_ids = block.ids.take(part["item"])
                columns = [part["id"], part["item"], item_ids, part["score"]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


@dataclass
class LexicalIndex:
    """Shards in a table of their own, and the two counts that their norms were made with."""

    shards: DataFrame
    n_docs: int
    n_terms: int

    @classmethod
    def build(cls, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """Two scans: one counts, one writes. What is added later changes the counts, so an index is made anew."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        said = rows.select("text").mapInArrow(_counter, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        n_docs, n_terms = said[0] or 0, said[1] or 0
        schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), StructField("norms", ArrayType(LongType()))])
        schema = StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{c} binary" for c in PARTS)).fields])
        shards = rows.mapInArrow(_indexer(n_docs, max(n_terms, 1), to_arrow_schema(schema)), schema)
        return cls(scratch.keep(shards, "shards"), n_docs, n_terms)

    def search(self, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", id_name: str = "doc_id") -> DataFrame:
        """(item_col, rank, id_name, score): the k best documents of each item, of scores above 0."""
        id_kind, item_kind = self.shards.schema["ids"].dataType.elementType, items.schema[item_col].dataType
        schema = StructType([StructField("id", id_kind), *StructType.fromDDL("item int").fields, StructField("item_id", item_kind), *StructType.fromDDL("score long").fields])
        blocks = enumerate(_blocks(items, item_col, text_col)) if self.n_docs else []
        parts = [self._block(block, k, schema).withColumn("block", F.lit(number)) for number, block in blocks]
        if not parts:
            parts = [self.shards.sparkSession.createDataFrame([], schema).withColumn("block", F.lit(0))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_name), "score")

    def _block(self, block: Block, k: int, schema: StructType) -> DataFrame:
        share = self.shards.sparkSession.sparkContext.broadcast
        terms = self.shards.select("terms", "ends").mapInArrow(_frequencies(share(block)), "term int, df long")
        df = np.zeros(len(block.terms), np.int64)
        for term, n in terms.groupBy("term").agg(F.sum("df")).collect():  # one row for each term of the block
            df[term] = n
        block.weights = np.array([term_weight(self.n_docs, int(n)) for n in df], np.int64)
        bounds = self.shards.select(F.size("ids"), "terms", "ends", "places", "impacts").mapInArrow(_lower_bounds(share(block), k), "bounds binary")
        tasks = max(1, self.shards.rdd.getNumPartitions())
        while tasks > 1:
            tasks = -(-tasks // FAN)
            bounds = bounds.repartition(tasks).mapInArrow(_merger(len(block.of), k), "bounds binary")
        merged = bounds.first()
        best = np.frombuffer(merged.bounds, np.int64).reshape(len(block.of), k) if merged else np.zeros((len(block.of), k), np.int64)
        block.least = best.min(1)
        columns = self.shards.select("ids", "norms", "terms", "ends", "places", "impacts", "counts")
        return columns.mapInArrow(_rescorer(share(block), k, to_arrow_schema(schema)), schema)


def _distinct_terms(kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                terms = sorted({t for p in pieces(text.as_py()) for t in p})
                ids = batch.column(0).take(pa.array(np.full(len(terms), row)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.binary())], schema=kinds)

    return run


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """All items with terms, block by block."""
    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"], *StructType.fromDDL("term binary").fields])
    terms = rows.mapInArrow(_distinct_terms(to_arrow_schema(schema)), schema).distinct()
    size = terms.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("id").alias("items")).first()
    n = max(-(-size.terms // BLOCK_TERMS), -(-size.items // BLOCK_ITEMS))
    for b in range(n):
        part = terms.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b).toArrow().sort_by([("id", "ascending"), ("term", "ascending")]).combine_chunks()
        if not part.num_rows:
            continue
        ids = part["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        words = part["term"].combine_chunks().dictionary_encode()
        number, owner = words.indices.to_numpy(), ids.indices.to_numpy()
        cuts = np.flatnonzero(np.diff(owner)) + 1
        yield Block(ids.dictionary, words.dictionary, np.split(number, cuts))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score) from an index made for this call."""
    index = LexicalIndex.build(docs, Scratch(docs.sparkSession, "lexical"), id_col, text_col)
    return index.search(items, k, item_col, item_text_col, id_col)


ORACLE = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where text is not null),
p as (select doc_id, term, count(*) as tf from t group by 1, 2),
d as (select doc_id, sum(tf)::bigint as n from p group by 1),
s as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by term, n_docs),
m as (select doc_id, 50 + ((50 * n * n_docs) // n_terms) as m from d, s),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join p using (term) join w using (term) join m using (doc_id) group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from r where score > 0
qualify rank <= 50
"""
