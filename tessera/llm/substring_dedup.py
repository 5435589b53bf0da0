"""Exact removal of repeated word windows, over a log-structured fingerprint index.

Every window of `window` words is represented by one fingerprint: the least hash among the `gram`-word grams in it.
Equal windows have equal fingerprints, and neighbouring windows mostly share one, so the index holds about
2 / (window - gram + 2) of the windows. The index is a log of sorted immutable runs of historical fingerprints: each
batch is merge-joined with the runs, what both have is repeated, the batch is added as a run and full levels are
compacted. Windows whose fingerprint is repeated are then verified on two independent 64-bit hashes of all their words,
counted over the corpus, and the words they cover are cut.

Texts that are equal form a class of which one member is indexed; with two members and a window's length, all goes.
Nothing gathers a fingerprint's or a window's places: both are counted with partial aggregates and joined back.

The index can be kept in a folder between sessions. Windows of texts ingested then count as starting elsewhere; those texts
are kept beside the runs, in a log of their own, for verification reads the ones whose fingerprints are asked for. It is
written after the runs: a session that dies between leaves fingerprints without texts, which make candidates and no cuts.

Defined results: null, empty or short texts have no window and lose nothing. A null id is a row like any other. Rows that
repeat, id included, are copies of each other. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import SortedRuns
from tessera.llm.scratch import Folder, Scratch
from tessera.llm.words import HASH, U64, ascii_words, rolling, signed, slices


def window_fingerprints(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(the gram hashes, for each window the least of its grams)."""
    grams = rolling(hashes, gram)
    width = window - gram + 1
    if len(grams) < width:
        return grams, np.empty(0, U64)
    least, span = grams, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return grams, np.minimum(least[:-rest], least[rest:]) if rest else least


def _fingerprinter(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            n, digests, prints = [], [], []
            for text in batch.column(3):
                words = ascii_words(text.as_py())
                grams, least = window_fingerprints(HASH.array(words), window, gram)
                chosen = np.unique(least)
                if len(chosen):  # a gram that stands twice in the text counts twice
                    values, counts = np.unique(grams, return_counts=True)
                    chosen = np.concatenate([chosen, np.intersect1d(chosen, values[counts > 1], assume_unique=True)])
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                prints.append(signed(chosen))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests), pa.array(prints, pa.list_(pa.int64()))], ["id", "k1", "k2", "n_words", "sha", "prints"])

    return run


def _windower(window: int, gram: int):
    """Rows (k1, k2, text, prints) -> the windows whose fingerprint is among prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for k1, k2, text, prints in zip(*batch.columns, strict=True):
                hashes = HASH.array(ascii_words(text.as_py()))
                _, least = window_fingerprints(hashes, window, gram)
                at = np.flatnonzero(np.isin(least, prints.values.to_numpy().view(U64)))
                own = [np.full(len(at), k.as_py()) for k in (k1, k2)]
                found = (*own, at, *(signed(rolling(hashes, window, seed))[at] for seed in (2, 3)))
                for col, x in zip(cols, found, strict=True):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["k1", "k2", "start", "w1", "w2"])

    return run


def _cutter(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (part for whole in batches for part in slices(whole, 2)):
            removed, digests, spans = [], [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                words, at = ascii_words(text.as_py()), np.sort(starts.values.to_numpy())
                fresh = np.flatnonzero(np.diff(at, prepend=-window - 1) > window)
                begins = at[fresh]
                ends = at[np.append(fresh[1:] - 1, len(at) - 1)] + window
                kept, last = [], 0
                for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                    kept += words[last:b]
                    last = e
                kept += words[last:]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"start": b, "end": e} for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, kind)], ["k1", "k2", "n_removed", "cut_sha", "spans"])

    return run


class WindowIndex:
    """The log of fingerprints and, if it is to last, the log of texts."""

    def __init__(self, scratch: Scratch, index_path: str | None):
        spark = scratch.spark
        self.prints = SortedRuns(Folder(spark, f"{index_path}/prints") if index_path else scratch, ["fp"], [F.sum("n").alias("n")])
        self.texts = None
        if index_path:
            folder, merge = Folder(spark, f"{index_path}/texts"), [F.first("text").alias("text"), F.first("prints").alias("prints")]
            self.texts = SortedRuns(folder, KEY, merge, fanout=16)
        self.scratch = scratch

    def known(self) -> DataFrame | None:
        """(k1, k2, text, prints) of the texts of earlier sessions."""
        return self.texts.rows() if self.texts else None

    def ingest(self, entries: DataFrame) -> DataFrame:
        """(fp) of those entries (fp, n) that the index or the batch itself has elsewhere; the batch becomes a run."""
        known = self.prints.rows()
        run = self.scratch.keep(entries.sortWithinPartitions("fp"), "batch")
        both = run.filter("n > 1").select("fp")
        if known is not None:
            both = both.unionByName(run.hint("merge").join(known.select("fp"), "fp", "left_semi").select("fp"))
        both = self.scratch.keep(both, "repeated")
        self.prints.add(run)
        self.scratch.drop(run)
        return both


KEY = ["k1", "k2"]
SPANS = "array<struct<start:long,end:long>>"


def _asking(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, prints): the classes with fingerprints among those found, and which."""
    hits = classes.select(*KEY, F.explode("prints").alias("fp")).join(found, "fp", "left_semi")
    return hits.groupBy(*KEY).agg(F.collect_set("fp").alias("prints"))


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 11, batches: int = 3,
    index_path: str | None = None,
) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, spans): spans are the word ranges [start, end) to cut from each text.

    index_path names a folder that keeps the index: what earlier calls ingested counts too. Each call has to use one window and gram.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    scratch = Scratch(docs.sparkSession, "substring")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    made = f"id {id_type}, k1 long, k2 long, n_words long, sha string, prints array<long>"
    prints = scratch.keep(docs.mapInArrow(_fingerprinter(window, gram), made), "prints")
    index = WindowIndex(scratch, index_path)
    old = index.known()
    classes = prints.filter(F.size("prints") > 0).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("prints").alias("prints"))
    if old is not None:  # a text of an earlier session is a copy of that
        classes = classes.join(old.select(*KEY, F.lit(True).alias("old")), KEY, "left")
        classes = classes.withColumn("copies", F.col("copies") + F.col("old").isNotNull().cast("int"))
    else:
        classes = classes.withColumn("old", F.lit(None).cast("boolean"))
    classes = scratch.keep(classes, "classes")
    fresh = classes.filter("old is null")

    repeated = []
    for b in range(batches):
        batch = fresh.filter(F.pmod("k1", F.lit(batches)) == b).select(F.explode("prints").alias("fp"))
        repeated.append(index.ingest(batch.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))))
    found = reduce(DataFrame.unionByName, repeated).distinct()
    asked = scratch.keep(_asking(fresh, found), "asked")
    if not index_path:
        index.prints.drop()
    earlier = scratch.keep(_asking(old, found).join(old.select(*KEY, "text"), KEY), "earlier") if old is not None else None
    scratch.drop(*repeated)
    scratch.release()

    # The least id of each class stands for it, and is part of the join key, so a hot class is spread.
    least = prints.groupBy(*KEY).agg(F.min("id").alias("least"))
    chosen = scratch.keep(asked.join(least, KEY).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "least", "prints"), "chosen")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("id").eqNullSafe(F.col("least"))
    texts = scratch.keep(docs.join(chosen, same).select(*KEY, "text", "prints"), "texts")
    cut_up = lambda rows: rows.select(*KEY, "text", "prints").mapInArrow(_windower(window, gram), "k1 long, k2 long, start long, w1 long, w2 long")
    windows = scratch.keep(cut_up(texts), "windows")
    scratch.release()
    place = F.struct(*KEY, "start")
    everywhere = windows if earlier is None else windows.unionByName(cut_up(earlier))
    twice = everywhere.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("w1", "w2")
    twice = scratch.keep(twice, "twice")
    starts = windows.join(twice, ["w1", "w2"], "left_semi").groupBy(*KEY).agg(F.collect_list("start").alias("starts"))
    starts = scratch.keep(starts.join(classes.filter("copies = 1").select(*KEY), KEY, "left_semi"), "starts")
    scratch.drop(windows, twice)
    scratch.release()
    cutter = _cutter(window)
    cut = texts.join(starts, KEY).select(*KEY, "text", "starts").mapInArrow(cutter, f"k1 long, k2 long, n_removed long, cut_sha string, spans {SPANS}")
    cut = scratch.keep(cut, "cut")
    whole = classes.filter("copies > 1").select(*KEY, F.lit(True).alias("whole"))
    decided = scratch.keep(cut.withColumn("whole", F.lit(False)).unionByName(whole, allowMissingColumns=True), "decided")
    if index.texts:
        index.texts.add(docs.join(fresh.select(*KEY, "prints"), KEY).groupBy(*KEY).agg(*index.texts.merge))
    scratch.drop(texts, starts, classes, cut, asked, chosen)
    all_of = F.col("whole") & F.col("whole").isNotNull()
    zero, none = F.lit(0).cast("long"), F.array().cast(SPANS)
    return prints.select("id", *KEY, "n_words", "sha").join(decided, KEY, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(all_of, F.col("n_words")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_of, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(all_of, F.array(F.struct(zero.alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35),
hashed as (select doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) as h from starts),
twice as (select h from hashed group by h having count(*) > 1),
hit as (select doc_id, s from hashed semi join twice using (h)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
marked as (select doc_id, word, k, coalesce(max(s) over (partition by doc_id order by k rows unbounded preceding) >= k - 34, false) as gone
  from words left join (select doc_id as i, s from hit) on doc_id = i and k = s),
kept as (select doc_id as i, count(*) filter (where gone) as n, string_agg(word, ' ' order by k) filter (where not gone) as text from marked group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on doc_id = i
"""
