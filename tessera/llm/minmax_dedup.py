"""Near-duplicate detection by min-max hashing.

Each document's set of word shingles is hashed once under each permutation and both the minimum and the maximum
are kept, so a signature of 2p values costs p hash evaluations. Bands of the signature make buckets; no bucket's pairs
are ever listed. Instead

1. documents with equal sets form a class, one representative of which goes on;
2. each bucket names one hub, the member with the most company over all bands, and its members are compared with the
   hub on their full sets, streamed past it;
3. connected components of the confirmed links are taken; where members of one hub are still in different components,
   those outside the hub's component are compared in blocks with all members of the hub, again streamed. A pair that
   shares a bucket is thus either compared or already in one component: banding alone decides recall.

Hubs and blocks are salted, so a group of any size is spread over tasks and a task holds one block only. A block is the
sets of CELL shingles in one sorted index: a document that streams past is held against all of them in one lookup, and a
task names one link between two components, not all. A member of a group of n documents of s shingles is sent once to a
block and n s / CELL times past one for each of its hubs, of which it has one a band at most; so up to CELL / s documents
(CELL_DOCS if they are shorter) rows grow with n, and beyond with its square over that: a row for hundreds of comparisons, all
of which exactness needs.

Defined results: ids may be of any type that sorts; those that are no integers are numbered in their order. Null or wordless texts have an empty set, are linked with nothing and kept. Fewer words than a shingle:
the whole sequence is the one shingle. A null id has a null component and is kept. Rows with one id are versions of one
document and share a component. Repeated rows have equal sets, so one component. An empty table gives an empty table.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from tessera.llm.components import connected_components
from tessera.llm.scratch import Scratch, sift
from tessera.llm.words import HASH, U64, ascii_words, mix, rolling, signed, slices

#: Members that stream past their hub in one task; shingles and documents of a block, and of what streams past it, about.
STREAM, CELL, CELL_DOCS = 128, 50_000, 256


def shingle_set(text: str | None, ngram: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = ascii_words(text, lower=True)
    return np.unique(rolling(HASH.array(words), min(ngram, len(words)))) if words else np.empty(0, U64)


def minmax_signature(shingles: np.ndarray, factors: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The minimum and the maximum of the shingles under each permutation; (p, 2)."""
    low, high = np.full(len(factors), ~U64(0)), np.zeros(len(factors), U64)
    for at in range(0, len(shingles), chunk):
        hashed = factors[:, None] * shingles[None, at : at + chunk]
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return np.stack([low, high], 1)


def permutation_factors(n: int, seed: int = 7) -> np.ndarray:
    """Odd factors: multiplication by one permutes the 64-bit integers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of `rows` values, told apart by the band's number."""
    values = signature.reshape(-1, rows)
    out = mix(np.arange(1, len(values) + 1, dtype=U64))
    for k in range(rows):
        out = mix(out * U64(3) + values[:, k])
    return out


def _signer(ngram: int, perms: int, rows: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = permutation_factors(perms)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, keys, bands = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), ngram)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(signed(band_hashes(minmax_signature(s, factors), rows)) if len(s) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


class Block:
    """Documents that stand while others stream past, and which components are known to be one."""

    def __init__(self):
        self.ids, self.comps, self.sets, self._index = [], [], [], None
        self._root: dict[int, int] = {}

    def add(self, i: int, comp: int, shingles: np.ndarray) -> None:
        self.ids.append(i)
        self.comps.append(comp)
        self.sets.append(shingles)

    def _build(self) -> None:
        self.ids, self.comps = np.array(self.ids, np.int64), np.array(self.comps, np.int64)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self._index, self._owner = np.unique(flat[order], return_index=True), owner[order]
        self._ends = np.append(self._index[1][1:], len(flat))
        self.sets = None

    def find(self, comp: int) -> int:
        while (up := self._root.get(comp, comp)) != comp:
            comp = up
        return comp

    def links(self, i: int, comp: int, shingles: np.ndarray, percent: int) -> list[int]:
        """A standing document for each other component that the document is linked to; these are then one."""
        if self._index is None:
            self._build()
        comp, n = self.find(comp), len(shingles)
        fits = (self.comps != comp) & (self.ids != i) & (100 * np.minimum(self.sizes, n) >= percent * np.maximum(self.sizes, n))
        if not fits.any():
            return []
        values, begins = self._index
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        at = at[values[at] == shingles]
        low, count = begins[at], self._ends[at] - begins[at]
        places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self._owner[places], minlength=len(self.ids))
        linked = np.flatnonzero(fits & (100 * both >= percent * (n + self.sizes - both)))
        out = []
        for k in linked.tolist():
            if (other := int(self.comps[k])) != comp:
                out.append(int(self.ids[k]))
                self._root[other] = comp
                self.comps[self.comps == other] = comp
        return out


def _confirmer(ngram: int, percent: int):
    """Rows (g, salt, block, role, id, c, text) ordered by group and role: role 0 stands, role 1 streams past; c is a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, Block()
        for batch in (part for whole in batches for part in slices(whole, 6)):
            a, b = [], []
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for g, salt, number, role, i, c, text in zip(*cols, batch.column(6), strict=True):
                if (g, salt, number) != group:
                    group, block = (g, salt, number), Block()
                if not role:
                    block.add(i, c, shingle_set(text.as_py(), ngram))
                elif len(block.ids):
                    found = block.links(i, c, shingle_set(text.as_py(), ngram), percent)
                    a += [i] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirm(rows: DataFrame, ngram: int, percent: int) -> DataFrame:
    ordered = rows.repartition("g", "salt", "block").sortWithinPartitions("g", "salt", "block", "role", "id")
    return ordered.select("g", "salt", "block", "role", "id", "c", "text").mapInArrow(_confirmer(ngram, percent), "a long, b long").distinct()


def _salt(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("salts"))


def _numbers(n: str) -> Column:
    """0 .. n - 1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _first_rows(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each hub against its members: a row a member, and the hub once for each STREAM of them."""
    zero = F.lit(0).cast("long").alias("block")
    streams = held.filter("hub != id").join(sizes, "hub")
    streams = streams.select(F.col("hub").alias("g"), _salt(1).alias("salt"), zero, F.lit(1).alias("role"), "id", F.col("id").alias("c"))
    hub = F.col("hub")
    stands = sizes.select(hub.alias("g"), _numbers("salts").alias("salt"), zero, F.lit(0).alias("role"), hub.alias("id"), hub.alias("c"))
    return streams.unionByName(stands)


def _late_rows(apart: DataFrame) -> DataFrame:
    """Members outside their hub's component (out) in blocks, and all members of the hub streaming past each block."""
    block = F.pmod(F.xxhash64(F.lit(2), "id"), F.col("blocks"))
    stands = apart.filter("out").select(F.col("hub").alias("g"), _numbers("salts").alias("salt"), block.alias("block"), F.lit(0).alias("role"), "id", "c")
    streams = apart.filter("hub != id")
    streams = streams.select(F.col("hub").alias("g"), _salt(1).alias("salt"), _numbers("blocks").alias("block"), F.lit(1).alias("role"), "id", "c")
    return stands.unionByName(streams)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, perms: int = 64, rows: int = 4
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): components of documents whose sets have 100 |A and B| >= percent |A or B|.

    perms permutations make 2 perms signature values in 2 perms / rows bands. With 64 and 4 a pair at the threshold
    goes unseen with probability (1 - s^4)^32: 6e-11 at 0.85, 5e-8 at 0.8.
    """
    if (2 * perms) % rows:
        raise ValueError("rows must divide 2 * perms")
    scratch = Scratch(docs.sparkSession, "minmax")
    kind = docs.schema[id_col].dataType
    number = F.col(id_col).cast("long") if isinstance(kind, IntegralType) else F.col(id_col)
    docs = docs.select(number.alias("id"), F.col(text_col).alias("text"))
    schema = StructType([docs.schema["id"], *StructType.fromDDL("n_shingles long, set_key binary, bands array<long>").fields])
    signed_docs = scratch.keep(docs.mapInArrow(_signer(ngram, perms, rows, to_arrow_schema(schema)), schema), "signed")
    usable = signed_docs.filter("id is not null and n_shingles > 0")
    classes = usable.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    numbers = None
    if not isinstance(kind, IntegralType):  # representatives by number, in the order of their ids
        classes = scratch.keep(classes.withColumnRenamed("rep", "name"), "named")
        ordered = classes.select("name").distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("rep"))
        numbers = scratch.keep(ordered, "numbers")
        classes = classes.join(numbers, "name").drop("name")
    classes = scratch.keep(classes.withColumn("rep", F.col("rep").cast("long")), "classes")

    banded = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), F.col("n").alias("size"))
    shared = scratch.keep(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    members = scratch.keep(banded.join(shared, "bucket"), "members")
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    ranked = members.select("bucket", "id").join(company, "id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("m"))).alias("h"))
    hubs = scratch.keep(hubs.select("bucket", (-F.col("h.m")).alias("hub")), "hubs")
    held = members.select("bucket", "id", "size").join(hubs, "bucket").groupBy("hub", "id").agg(F.max("size").alias("size"))
    held = scratch.keep(held, "held")

    # Counts by hub are written before they are joined back: else the join inherits their partitions, which can't be split.
    sizes = scratch.keep(held.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("long").alias("salts")), "sizes")
    # An inner join: a semi join would be pushed below the sift and shuffle all texts.
    wanted = held.select("id").distinct()
    if numbers is None:
        texts = sift(docs, F.col("id"), wanted, F.col("id")).join(wanted, "id")
    else:
        wanted = wanted.join(numbers.withColumnRenamed("rep", "id"), "id")
        texts = sift(docs, F.col("id"), wanted, F.col("name")).withColumnRenamed("id", "name").join(wanted, "name").drop("name")
    texts = scratch.keep(texts, "texts")
    links = scratch.keep(_confirm(_first_rows(held, sizes).join(texts, "id"), ngram, percent), "links")

    found = connected_components(links, scratch)
    comp = lambda name: F.coalesce(F.col("comp"), F.col(name))
    placed = scratch.keep(held.join(found, "id", "left").select("hub", "id", "size", comp("id").alias("c")), "placed")
    home = placed.filter("hub = id").select("hub", F.col("c").alias("home"))
    apart = scratch.keep(placed.join(home, "hub").withColumn("out", F.col("c") != F.col("home")), "apart")
    cells = lambda size: F.greatest(F.ceil(F.sum(size) / CELL), F.ceil(F.count(size) / CELL_DOCS)).cast("long")
    counts = apart.groupBy("hub").agg(cells(F.when(F.col("out"), F.col("size"))).alias("blocks"), cells(F.col("size")).alias("salts"))
    counts = scratch.keep(counts.filter("blocks > 0"), "counts")
    late = _confirm(_late_rows(apart.join(counts, "hub")).join(texts, "id"), ngram, percent)
    late = scratch.keep(late, "late")
    if not late.isEmpty():
        found = connected_components(links.unionByName(late), scratch)

    named = classes.select("set_key", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("set_key", comp("rep").alias("component_id"))
    if numbers is not None:
        named = named.join(numbers.withColumnRenamed("rep", "component_id"), "component_id").select("set_key", F.col("name").alias("component_id"))
    named = scratch.keep(named, "named")
    key = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key")
    out = signed_docs.select("id", "n_shingles", key).join(named, "set_key", "left")
    component = F.coalesce("component_id", "id")
    scratch.drop(members, hubs, shared, held, sizes, counts, apart, texts, placed, links, late, classes)
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) end) as s from w),
shingles as (select doc_id as id, len(s) as n, unnest(s) as x from sets),
pairs as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from shingles a join shingles b on a.x = b.x and a.id <> b.id group by 1, 2),
links as materialized (select a, b from pairs where 100 * common >= 85 * (na + nb - common)),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join links l on r.b = l.a),
named as (select a, min(b) as component_id from reach group by a)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join named on doc_id = a
"""
