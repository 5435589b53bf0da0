"""Retrieval and transcription quality."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import parsing

DIFF_THRESHOLD, VERBOSE_BELOW, DIFF_ROWS, MAX_EDIT_CHARS = 0.05, 0.9995, 10, 12_000


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked results with their grade, 0 for what is not relevant."""
    return ranked.join(qrels, ["query_id", "message_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) of every query with relevant messages."""
    gain = lambda rank: F.col("grade") / (F.log(rank + 1.0) / F.log(F.lit(2.0)))
    got = judged(ranked, qrels).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "message_id"))
    best = qrels.withColumn("rank", place).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 9).alias("ndcg"))


def mrr(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    first = judged(ranked, qrels).filter((F.col("grade") > 0) & (F.col("rank") <= k)).groupBy("query_id").agg(F.min("rank").alias("first"))
    return qrels.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("mrr"))


def recall(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    hits = judged(ranked, qrels).filter((F.col("grade") > 0) & (F.col("rank") <= k)).groupBy("query_id").agg(F.countDistinct("message_id").alias("hits"))
    gold = qrels.groupBy("query_id").agg(F.countDistinct("message_id").alias("gold"))
    return gold.join(hits, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("gold"), 9).alias("recall"))


def specificity(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Of queries that should find nothing: 1 less the share of the list that is filled."""
    n = ranked.filter(F.col("rank") <= k).join(qrels.select("query_id"), "query_id", "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("query_id", (1 - F.least(F.lit(1.0), F.col("n") / F.lit(float(k)))).alias("specificity"))


def ranks(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Where each relevant message stands, 0 for a miss."""
    return qrels.join(ranked.select("query_id", "message_id", "rank"), ["query_id", "message_id"], "left").select("query_id", "message_id", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


def baseline_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """The queries whose NDCG moved most, and by a margin."""
    both = base.withColumnRenamed("ndcg", "before").join(current.withColumnRenamed("ndcg", "after"), "query_id").withColumn("delta", F.round(F.col("after") - F.col("before"), 9))
    return both.filter(F.abs("delta") >= DIFF_THRESHOLD).orderBy(F.abs("delta").desc(), "query_id").limit(DIFF_ROWS)


#: What a transcribed page is known by.
PAGE = ["attachment_id", "page"]


def against(results: DataFrame, references: DataFrame) -> DataFrame:
    """Each page's result with its reference; null where there is none, as a page that no one has written off has."""
    return results.join(references.select(*PAGE, "reference"), PAGE, "left")


def token_f1(pages: DataFrame) -> DataFrame:
    """(engine, attachment_id, page, f1) over multisets of tokens; failed pages, and those without any token, are left out.

    Both texts of a page are in one row, so nothing is shuffled.
    """
    same = F.col("reference") == F.col("hypothesis")
    f1 = parsing.column(_f1, "double", same, "reference", F.when(F.coalesce(~same, F.lit(True)), F.col("hypothesis")))
    return pages.filter("error is null").select("engine", *PAGE, F.round(f1, 9).alias("f1")).filter("f1 is not null")


def _f1(same: bool | None, reference: str | None, hypothesis: str | None) -> float | None:
    """Equal texts need only be looked at for one token."""
    return (1.0 if parsing.word_search(reference) else None) if same else parsing.token_f1(reference, hypothesis)


def engine_agreement(pages: DataFrame) -> DataFrame:
    """(engine_a, engine_b, f1, pages): mean F1 of the tokens of two engines on the pages both have read.

    A page's texts meet, one for each engine; its tokens are counted where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for read in batch.column(0).to_pylist():
                counts: dict[str, Counter] = {}
                for r in read:
                    counts.setdefault(r["engine"], Counter()).update(parsing.word_tokens(r["hypothesis"]))
                some = sorted(e for e, c in counts.items() if c)
                out += [(a, b, parsing.multiset_f1(counts[a], counts[b])) for k, a in enumerate(some) for b in some[k + 1 :]]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["engine_a", "engine_b", "f1"])

    read = pages.filter("error is null").groupBy(*PAGE).agg(F.collect_list(F.struct("engine", "hypothesis")).alias("read"))
    pairs = read.select("read").mapInArrow(run, "engine_a string, engine_b string, f1 double")
    return pairs.groupBy("engine_a", "engine_b").agg(F.round(F.avg("f1"), 9).alias("f1"), F.count(F.lit(1)).alias("pages"))


def _unless_equal(a, b) -> tuple:
    """The pair, or two empty texts for equal ones, which have no error and need not be read."""
    return tuple(F.when(a == b, F.lit("")).otherwise(x) for x in (a, b))


def character_error(reference, hypothesis):
    """Edit distance over the reference's length, at most 1, of texts cut to MAX_EDIT_CHARS."""
    r, h = F.substring(reference, 1, MAX_EDIT_CHARS), F.substring(hypothesis, 1, MAX_EDIT_CHARS)
    return parsing.column_of(parsing.character_errors, "double", *_unless_equal(r, h))


def word_error(reference, hypothesis):
    """Edit distance over words by the reference's words, at most 1."""
    return parsing.column_of(parsing.word_error_rates, "double", *_unless_equal(F.col(reference), F.col(hypothesis)))


def at_index(values, share: float):
    """The value at floor(share * n) of the sorted values, the last at most."""
    return F.element_at(F.array_sort(values), F.least(F.size(values), F.floor(F.size(values) * F.lit(share)).cast("int") + 1))
