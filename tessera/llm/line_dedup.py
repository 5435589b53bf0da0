"""Removal of lines repeated across documents, over levelled sorted runs of line hashes.

A run holds (128-bit hash of a line's key, documents that hold it, largest id that holds it), sorted by hash. Each batch of
documents is aggregated to such entries and merge-anti-joined with the runs: entries that cannot change what the runs
already say (the line is past the threshold and a larger id holds it) are left out, the rest become a run of their own;
full levels are compacted. Over the merged runs a line past the threshold is dropped everywhere but in the largest id.
The runs can be kept in a folder between sessions: what was ingested then counts as documents of the table.

Hot lines do not gather: counting pre-aggregates before its shuffle, and a batch's entry for a line that over 1/HOT of the
batch's lines are always enters the run, so the runs tell which lines are hot. There can be HOT of them for each batch;
they are looked up in a broadcast table, the others by a shuffled join.

A text costs time and memory in proportion to its length: lines are hashed one after the other, repeats within a text are
found by a dictionary, and the text is cut at the sorted numbers of the lines that go.

Defined results: ids may be of any type that sorts. A null or empty text is one empty line. Lines of null ids are neither counted nor dropped. Each row
counts as a document, also one that repeats; rows with the largest id all keep the line. A line's copies within one
document count once and go or stay together. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.runs import SortedRuns
from tessera.llm.scratch import Folder, Scratch
from tessera.llm.words import slices

#: What is stripped from a line, and the letters that are folded.
BLANK = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 2048
LINES = "t long, h1 long, h2 long, at array<int>"


def line_key(line: bytes) -> bytes:
    """UTF-8 in and out; bytes fold A-Z only."""
    return line.strip(BLANK).lower()


def long_enough(key: bytes, chars: int) -> bool:
    """Whether a key has so many code points; continuation bytes of UTF-8 begin none."""
    return len(key) >= chars and (len(key) >= 4 * chars or sum(b & 0xC0 != 0x80 for b in key) >= chars)


def places_of_lines(text: str, min_chars: int) -> dict[bytes, list[int]]:
    """128-bit hash of each key -> the numbers of its lines."""
    out: dict[bytes, list[int]] = {}
    for n, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line_key(line)
        if long_enough(key, min_chars):
            out.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
    return out


def _hasher(min_chars: int):
    """Rows (id, t, text) -> a row for each distinct line of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            row, hashes, sizes, places = [], [], [], []
            for r, text in enumerate(batch.column(2)):
                found = places_of_lines(text.as_py() or "", min_chars)
                row += [r] * len(found)
                hashes += found
                sizes += map(len, found.values())
                for at in found.values():
                    places += at
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            at = pa.ListArray.from_arrays(ends, pa.array(places, pa.int32()))
            chosen = pa.array(row, pa.int64())
            first = [batch.column(k).take(chosen) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*first, pa.array(halves[:, 0]), pa.array(halves[:, 1]), at], ["id", "t", "h1", "h2", "at"])

    return run


class LineIndex:
    """The runs, with the rule that says which lines go."""

    def __init__(self, folder: Scratch | Folder, min_docs: int):
        self.min_docs = min_docs
        self.runs = SortedRuns(folder, ["h1", "h2"], [F.sum("docs").alias("docs"), F.max("last").alias("last")])

    def ingest(self, lines: DataFrame, often: int | None = None) -> None:
        """lines (id, h1, h2), a line once for each document; entries of `often` documents enter in any case."""
        batch = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"))
        known = self.runs.merged()
        if known is not None:
            known = known.filter(F.col("docs") >= self.min_docs).select("h1", "h2", F.col("last").alias("settled"))
            says = (batch.h1 == known.h1) & (batch.h2 == known.h2) & (batch.last <= known.settled)
            if often is not None:
                says = says & (batch.docs < often)
            batch = batch.hint("merge").join(known, says, "left_anti")
        self.runs.add(batch)

    def repeated(self) -> DataFrame:
        """(h1, h2, docs, last) of the lines past the threshold; docs is a lower bound once settled."""
        return self.runs.merged().filter(F.col("docs") >= self.min_docs)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
    batches: int = 3, index_path: str | None = None,
) -> DataFrame:
    """(row, id, n_lines, n_dropped, kept_text): row is the input row whole.

    index_path names a folder that keeps the runs. What it holds from earlier calls counts: a line is dropped here also for
    documents of then, and stays only in ids larger than any before. A document is to be ingested once.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    lines = docs.filter("id is not null").select("id", "t", "text")
    lines = lines.mapInArrow(_hasher(min_chars), StructType([lines.schema["id"], *StructType.fromDDL(LINES).fields]))
    lines = scratch.keep(lines, "lines")
    index = LineIndex(Folder(docs.sparkSession, index_path) if index_path else scratch, min_docs)
    often = math.ceil(lines.count() / batches / HOT) + 1
    for b in range(batches):
        index.ingest(lines.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b).select("id", "h1", "h2"), often)
    gone = scratch.keep(index.repeated(), "gone")
    # At most HOT * batches lines, also where the runs tell of many more documents than this table has.
    often = max(often, math.ceil((gone.agg(F.sum("docs")).first()[0] or 0) / HOT / batches))
    hot = F.broadcast(gone.filter(F.col("docs") >= often).select("h1", "h2", "last"))
    rest = lines.join(hot, ["h1", "h2"], "left_anti").join(gone.select("h1", "h2", "last"), ["h1", "h2"])
    hits = lines.join(hot, ["h1", "h2"]).unionByName(rest).filter("id < last")
    # Rows that share id and text share the numbers too, so a number may come more than once.
    drops = hits.select("id", "t", F.explode("at").alias("n")).groupBy("id", "t").agg(F.sort_array(F.collect_set("n")).alias("drops"))
    drops = scratch.keep(drops, "drops")
    if not index_path:
        index.runs.drop()
    scratch.drop(lines, gone)
    # The cell binds what would else be made anew for each line.
    cell = F.struct("text", F.split("text", "\n").alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    return docs.join(drops, ["id", "t"], "left").select("row", "id", F.inline(F.transform(F.array(cell), _cut)))


def _cut(x: Column) -> Column:
    """(n_lines, n_dropped, kept_text) of a text: the stretches between the lines that go. Each line is copied once."""
    ends = F.concat(F.array(F.lit(-1)), x["drops"], F.array(F.size(x["lines"])))

    def kept(y: Column) -> Column:
        def stretch(k: Column) -> Column:
            begin = F.get(y["ends"], k) + 1
            return F.slice(y["lines"], begin + 1, F.get(y["ends"], k + 1) - begin)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(y["ends"]) - 2), stretch)), "\n")

    bound = F.array(F.struct(x["lines"].alias("lines"), ends.alias("ends")))
    text = F.when(F.size(x["drops"]) == 0, x["text"]).otherwise(F.get(F.transform(bound, kept), F.lit(0)))
    count = lambda c: F.size(c).cast("long")
    return F.struct(count(x["lines"]).alias("n_lines"), count(x["drops"]).alias("n_dropped"), text.alias("kept_text"))


ORACLE = """
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from split),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
gone as (select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select keyed.*, gone.k is not null and doc_id <> last as dropped from keyed left join gone on keyed.k = gone.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""
