"""Benchmark decontamination by greedy string tiling.

Items and documents become lower-cased alphanumeric words. Words runs of `least` that an item and a document share are
seeds; only documents with seeds that could cover `coverage` of an item are tiled against it. Tiling is running
Karp-Rabin: rolling hashes of a search length find common runs among unmarked words, the longest are marked first and
never overlap, and the length is halved until it is `least`. An item counts as leaked when the marked words are at least
`coverage` of it, whatever the order in which its passages stand.

Items are taken in blocks of bounded size, each broadcast and held against all documents; documents are never shuffled.
The driver holds one block at a time while it makes the broadcasts.

Defined results: null or empty texts share nothing. Items of fewer than `least` words are matched whole. Items without words
match nothing. Ids of items and documents may be of any type that sorts. Items with one text and different ids are items of
their own, items that repeat whole count once; repeated documents give repeated rows. Null ids are passed on.
Empty tables give an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tessera.llm.words import HASH, U64, rolling, slices

WORD = re.compile(r"[^\W_]+")
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8_000_000
SIEVE_BITS = 22


def words_of(text: str | None) -> np.ndarray:
    return HASH.array([w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").lower())])


def _windows_free(marked: np.ndarray, length: int) -> np.ndarray:
    """For each window of some length whether nothing in it is marked."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[length:] == total[:-length]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length): again and again the longest run of words that both have unmarked.

    Of equally long runs that with the smallest start in the item goes first, then in the document. The search length runs
    down by halves; once windows of it meet, the largest length that does is found by bisection, and all its tiles are
    marked in one pass. No pairs of places are listed, so memory and time do not grow with their product.
    """
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of the item and of the document that the other one has, and the hashes of the item's."""
        left, right = rolling(item, length), rolling(doc, length)
        p, t = np.flatnonzero(_windows_free(in_item, length)), np.flatnonzero(_windows_free(in_doc, length))
        both = np.intersect1d(left[p], right[t])
        return p[np.isin(left[p], both)], t[np.isin(right[t], both)], left

    def mark(length: int) -> None:
        starts, places, left = common(length)
        hashes = rolling(doc, length)[places]
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        at: dict[int, int] = {}  # hash -> how many of its places are known to be taken
        for p in starts.tolist():
            if in_item[p : p + length].any():
                continue
            h = left[p]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            k = at.get(int(h), int(low))
            while k < high and in_doc[places[k] : places[k] + length].any():
                k += 1
            at[int(h)] = k
            if k < high:
                t = int(places[k])
                in_item[p : p + length] = in_doc[t : t + length] = True
                out.append((p, t, length))

    top = min(len(item), len(doc))  # nothing longer is left
    search = top
    while search >= least:
        if not len(common(search)[0]):
            top, search = search - 1, max(least, search // 2) if search > least else 0
            continue
        low, high = search, top  # the longest is one of these
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        mark(low)
        top = low - 1
        search = min(search, top) if top >= least else 0
    return out


class ItemIndex:
    """Seeds of a block of items."""

    def __init__(self, ids: pa.Array, texts: list[str | None], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.ids, self.items = ids, [words_of(t) for t in texts]
        self.spans = np.array([min(least, len(w)) for w in self.items], np.int64)
        seeds, owners, places = [], [], []
        self.sizes = sorted({min(least, len(w)) for w in self.items if len(w)})
        for n, w in enumerate(self.items):
            if len(w):
                h = rolling(w, min(least, len(w)))
                seeds.append(h)
                owners.append(np.full(len(h), n))
                places.append(np.arange(len(h)))
        self.seeds = np.concatenate(seeds) if seeds else np.empty(0, U64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owners = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.empty(0, np.int64)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.seeds >> U64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def _covered(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(number of an item, its words inside seeds that the text has), for items with such seeds."""
        owners, places = [], []
        for k in self.sizes:
            h = rolling(words, k)
            h = np.unique(h[self.sieve[(h >> U64(64 - SIEVE_BITS)).astype(np.int64)]])
            low, high = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = at[self.spans[self.owners[at]] == k]
            owners.append(self.owners[at])
            places.append(self.places[at])
        owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, places))
        if not len(owner):
            return
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        span = self.spans[owner]
        follows = np.append(owner[1:] == owner[:-1], False)
        fresh = np.where(follows, np.minimum(np.append(place[1:], 0) - place, span), span)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        yield from zip(owner[first].tolist(), np.add.reduceat(fresh, first).tolist(), strict=True)

    def leaks(self, text: str | None) -> Iterator[tuple[int, list[tuple[int, int, int]], int]]:
        """(number of the item, tiles, words marked) of the items that the text leaks."""
        words = words_of(text)
        for n, could in self._covered(words):
            item = self.items[n]
            if could >= self.coverage * len(item):
                tiles = greedy_tiles(item, words, min(self.least, len(item)))
                marked = sum(t[2] for t in tiles)
                if marked >= self.coverage * len(item):
                    yield n, tiles, marked


def _blocks(bench: DataFrame, id_col: str, text_col: str, least: int, coverage: float) -> Iterator[ItemIndex]:
    """Indexes of all items, block by block; a block's size is bounded by the number of blocks, as no two of its rows are the same."""
    bench = bench.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for b in range(n):
        part = bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).toArrow()
        part = part.sort_by([("id", "ascending"), ("text", "ascending")])
        yield ItemIndex(part["id"].combine_chunks(), part["text"].to_pylist(), least, coverage)


TILES = "array<struct<item_word:long,doc_word:long,n:long>>"


def benchmark_leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", least: int = 5, coverage: float = 0.5,
) -> DataFrame:
    """(id_col, item_col, item_words, matched_words, n_tiles, coverage, tiles) for each leaked item of each document."""
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType.fromDDL(f"item_words long, matched_words long, n_tiles long, coverage double, tiles {TILES}")
    schema = StructType([rows.schema["id"], StructField("item", bench.schema[item_col].dataType), *schema.fields])
    kinds = to_arrow_schema(schema)

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in (part for whole in batches for part in slices(whole, 1)):
                at, items, found = [], [], []
                for r, text in enumerate(batch.column(1)):
                    for n, tiles, marked in index.leaks(text.as_py()):
                        at.append(r)
                        items.append(n)
                        size = len(index.items[n])
                        said = [{"item_word": p, "doc_word": t, "n": k} for p, t, k in sorted(tiles)]
                        found.append((size, marked, len(tiles), marked / size, said))
                cols = [batch.column(0).take(pa.array(at, pa.int64())), index.ids.take(pa.array(items, pa.int64())), *(list(zip(*found, strict=True)) or [[]] * 5)]
                cols = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

        return run

    share = spark.sparkContext.broadcast
    parts = [rows.mapInArrow(finder(share(index)), schema) for index in _blocks(bench, item_col, item_text_col, least, coverage)]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaking(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least: int = 5, coverage: float = 0.5,
) -> DataFrame:
    """The documents, columns and all, that leak no item."""

    def keeper(shared, column: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = [next(index.leaks(t.as_py()), None) is None for t in batch.column(column)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    out, schema = docs, StructType(docs.schema.fields)
    for index in _blocks(bench, item_col, item_text_col, least, coverage):
        out = out.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)), schema)
    return out
