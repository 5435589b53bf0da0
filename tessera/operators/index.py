"""A stored keyword index: postings sorted by term, so a query reads the row groups of its terms and nothing else."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import keyword
from tessera.sources.versions import Conflict, VersionLog

#: Runs of one level that are merged into one of the next; the level of the run that build() writes.
FANOUT, BASE = 4, 99
#: Ids of a change that are looked up by value, so that row groups without them are not read; more are joined.
LOOKED_UP, TRIES = 1000, 20
#: Of so many documents about, and of so many of their postings, the ranges of a run's files are made; a file gets PER_FILE postings about,
#: but there are no more than MOST_FILES, which Spark's shuffle writes side by side, without a sort that would hold and spill them.
SAMPLED, SEEN, PER_FILE, MOST_FILES = 4096, 1 << 15, 1_000_000, 200


@dataclass(frozen=True)
class KeywordIndex:
    """Postings with each document's length, the number of documents and their mean length; analyser is what made the terms.

    The index is a log of runs, oldest first. A run holds the postings and lengths of some documents and the ids (gone) of
    which all older runs count no more: those it indexes anew and those deleted. So a change costs what it changes, and a lookup of
    the lengths it takes back. Runs of one level are merged, FANOUT at a time; once changes outgrow half of what build() wrote,
    everything is. The runs, and the two sums over documents, are facts of a version (see sources.versions): a change that breaks
    off leaves the index as it was, and of two changes at once the second is put on top of the first.
    """

    postings: DataFrame
    n: int
    avglen: float
    analyser: str = "plain"
    path: str = ""
    runs: tuple[tuple[str, int], ...] = field(default=())

    @classmethod
    def build(cls, docs: DataFrame, path: str, analyser: str = "plain") -> KeywordIndex:
        """Index all documents as one run. What the path held before counts no more."""
        spark = docs.sparkSession
        name = _write(docs, keyword.postings(docs, analyser=analyser), docs.limit(0).select("id"), path)
        n, total = _sums(_read(spark, path, name, "documents"))
        return _publish(spark, path, lambda facts: {"runs": [[name, BASE]], "analyser": analyser, "n": n, "total": total})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        facts = VersionLog(spark, path).snapshot().facts
        if not facts:
            raise FileNotFoundError(f"no index at {path}")
        return _opened(spark, path, facts)

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> KeywordIndex:
        """Documents of `changed` are indexed anew, those of deleted (id) are gone; on top of what others have made of it since."""
        spark = changed.sparkSession
        gone = changed.select("id") if deleted is None else changed.select("id").union(deleted.select("id"))
        name = _write(changed, keyword.postings(changed, analyser=self.analyser), gone.distinct(), self.path)
        new = _sums(_read(spark, self.path, name, "documents"))

        def with_run(facts: dict) -> dict:
            runs = [tuple(r) for r in facts["runs"]]
            old = _sums(_of_ids(_live(spark, self.path, runs, "documents"), _read(spark, self.path, name, "gone")))
            sums = {k: facts[k] - o + a for k, o, a in zip(("n", "total"), old, new, strict=True)}
            runs.append((name, 0))
            while len(runs) > FANOUT and len({level for _, level in runs[-FANOUT:]}) == 1:
                runs[-FANOUT:] = [(_merge(spark, self.path, runs[-FANOUT:], len(runs) == FANOUT), runs[-1][1] + 1)]
            size = lambda some: sum(_read(spark, self.path, run, "documents").count() for run, _ in some)
            if len(runs) > 1 and size(runs[1:]) * 2 > size(runs[:1]):
                runs = [(_merge(spark, self.path, runs, True), BASE)]
            return {**facts, **sums, "runs": [list(r) for r in runs]}

        return _publish(spark, self.path, with_run)

    def cache(self) -> KeywordIndex:
        return replace(self, postings=self.postings.cache())


def _merge(spark: SparkSession, path: str, runs: list[tuple[str, int]], whole: bool) -> str:
    """The runs as one. It still hides what older runs say of their ids, unless these are all."""
    gone = reduce(DataFrame.union, (_read(spark, path, name, "gone") for name, _ in runs)).distinct()
    docs = _live(spark, path, runs, "documents")
    return _write(docs, _live(spark, path, runs, "postings"), gone.limit(0) if whole else gone, path)


def _sums(documents: DataFrame) -> tuple[int, int]:
    said = documents.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).first()
    return said.n, said.total or 0


def _of_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    few = [r.id for r in ids.limit(LOOKED_UP + 1).collect()]
    return documents.filter(F.col("id").isin(few)) if len(few) <= LOOKED_UP else documents.join(ids, "id", "left_semi")


def _read(spark: SparkSession, path: str, name: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}/{part}")


def _write(docs: DataFrame, postings: DataFrame, gone: DataFrame, path: str) -> str:
    """Range-partitioned by term and document, so that a term of any frequency is spread over files."""
    spark, name = docs.sparkSession, f"run-{uuid.uuid4().hex}"
    _ranged(postings, docs.select("id").count()).sortWithinPartitions("term", "id").write.parquet(f"{path}/{name}/postings")
    gone.write.parquet(f"{path}/{name}/gone")
    # Whatever has a posting has one at the start of a field.
    sizes = _read(spark, path, name, "postings").filter("pos = 0").groupBy("id").agg(F.max("len").alias("len"))
    docs.select("id").join(sizes, "id", "left").select("id", F.coalesce("len", F.lit(0)).alias("len")).sortWithinPartitions("id").write.parquet(f"{path}/{name}/documents")
    return name


def _ranged(postings: DataFrame, documents: int) -> DataFrame:
    """Postings by ranges of (term, id). Spark's own ranges would need all postings made twice, first for their sample; here only those of some documents are."""
    few = postings.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, documents // SAMPLED))) == 0)
    seen = few.orderBy(F.xxhash64("id", "field", "pos")).limit(SEEN).select("term", "id", "len").collect()
    if not seen or any(r.id is None for r in seen):
        return postings.repartitionByRange("term", "id")
    # Postings show long documents as often as they are long, so the mean length is the harmonic one.
    total = documents * len(seen) / sum(1 / r.len for r in seen)
    files = min(MOST_FILES, len(seen), 1 + int(total / PER_FILE))
    places = sorted((r.term.encode(), r.id, r.term) for r in seen)
    bounds = [places[k * len(places) // files][1:] for k in range(1, files)]
    return postings.repartitionById(files, _file_of(bounds, 0, files - 1))


def _file_of(bounds: list[tuple], first: int, last: int) -> Column:
    """The number from first to last of the range that a posting falls into, by halves."""
    if first == last:
        return F.lit(first)
    middle = (first + last + 1) // 2
    ident, term = bounds[middle - 1]
    above = (F.col("term") > term) | ((F.col("term") == term) & (F.col("id") >= F.lit(ident)))
    return F.when(above, _file_of(bounds, middle, last)).otherwise(_file_of(bounds, first, middle - 1))


def _live(spark: SparkSession, path: str, runs, part: str) -> DataFrame:
    """What the runs hold and no later one hides."""
    parts, hidden = [], None
    for name, _ in reversed(runs):
        rows = _read(spark, path, name, part)
        parts.append(rows if hidden is None else rows.join(hidden, "id", "left_anti"))
        gone = _read(spark, path, name, "gone")
        hidden = gone if hidden is None else hidden.union(gone)
    return reduce(DataFrame.unionByName, parts)


def _opened(spark: SparkSession, path: str, facts: dict) -> KeywordIndex:
    runs = tuple((name, level) for name, level in facts["runs"])
    return KeywordIndex(_live(spark, path, runs, "postings"), facts["n"], facts["total"] / max(facts["n"], 1), facts["analyser"], path, runs)


def _publish(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> KeywordIndex:
    """Commit what `change` makes of the latest facts, made anew where another writer came first."""
    log = VersionLog(spark, path)
    for k in range(TRIES):
        at = log.snapshot()
        facts = change(at.facts)
        try:
            log.commit({}, at, facts)
            break
        except Conflict:
            if k == TRIES - 1:
                raise
    return _opened(spark, path, facts)
