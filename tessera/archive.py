"""The archive as one object: search, reading, upkeep and checks over its tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import parsing, text
from tessera.operators import archive, batch_search, evalkit, fusion, ingest, keyword, ocr, vectors
from tessera.operators.filters import SearchFilters, apply_filters, clamp_limit, live, parse_date
from tessera.operators.index import KeywordIndex
from tessera.sources.versions import VersionLog

MODES = ("keyword", "semantic", "hybrid")
PAGE_DEFAULT, PAGE_MAX = 50_000, 200_000
TABLES = {"messages": schemas.MESSAGES, "attachments": schemas.ATTACHMENTS, "chunks": schemas.CHUNKS, "chunk_embeddings": schemas.CHUNK_EMBEDDINGS, "sync_state": schemas.SYNC_STATE, "metadata": schemas.METADATA}


class SpaceMismatch(RuntimeError):
    """The stored vectors are of another embedding space than the query's."""


@dataclass
class Archive:
    """Tables as DataFrames; chunks may carry their embedding or have it in chunk_embeddings.

    embed turns a query into a vector of the stored space; identity describes that space, and where the stored metadata
    says otherwise semantic search is refused. Keyword search stems and folds unless analyser is "plain"; an index keeps its own.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    embed: Callable[[str], Sequence[float]] | None = None
    identity: dict[str, str] = field(default_factory=dict)
    index: KeywordIndex | None = None
    analyser: str = "porter"

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Archive:
        """The tables of one version below a root, the latest."""
        log = VersionLog(spark, root)
        at = log.snapshot()
        return cls(spark, {t: log.read(t, at) for t in TABLES}, **options)

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: dict[str, DataFrame] | None = None, **options) -> Archive:
        """Publish tables as one version, those not given as empty ones."""
        given = tables or {}
        VersionLog(spark, root).update(lambda at: {n: given[n] if n in given else spark.createDataFrame([], s) for n, s in TABLES.items()})
        return cls.open(spark, root, **options)

    @classmethod
    def change(cls, spark: SparkSession, root: str, how: Callable[[Archive], dict[str, DataFrame]], **options) -> Archive:
        """Publish the tables that `how` makes of the latest version, all at once; made anew where another writer came first."""
        log = VersionLog(spark, root)
        log.update(lambda at: how(cls(spark, {t: log.read(t, at) for t in TABLES}, **options)))
        return cls.open(spark, root, **options)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name not in tables:
            raise AttributeError(name)
        return tables[name]

    def vectors(self) -> DataFrame:
        if "embedding" in self.chunks.columns:
            return self.chunks
        return self.chunks.join(self.chunk_embeddings, F.col("id") == F.col("chunk_id")).drop("chunk_id")

    def _query_vector(self, query: str) -> DataFrame:
        if self.embed is None:
            raise ValueError("semantic search needs an embedder")
        if "metadata" in self.tables and self.identity:
            stored = {r.key: r.value for r in self.metadata.filter(F.col("key").isin("drift", *self.identity)).collect()}
            if why := ingest.space_conflict(stored, self.identity):
                raise SpaceMismatch(why)
        return self.spark.createDataFrame([([float(x) for x in self.embed(query)],)], "q array<float>")

    # --- reading ---
    def search(self, query: str = "", mode: str = "hybrid", filters: SearchFilters | None = None, limit: int | None = None) -> DataFrame:
        """Hits, best first: rank, id, message_id, folder, subject, sender, date, snippet, score, ranks, attachment.

        Without a query the messages that pass the filters, latest first; without either nothing.
        """
        if mode not in MODES:
            raise ValueError(f"the mode is one of {', '.join(MODES)}")
        filters, limit = filters or SearchFilters(), clamp_limit(limit)
        kept = apply_filters(live(self.messages), filters, self.tables.get("attachments"), self.tables.get("sync_state"))
        none = lambda kind: F.lit(None).cast(kind)
        if not query.strip():
            rows = kept.filter(F.lit(not filters.is_empty)).orderBy(F.col("date_sent").desc_nulls_last(), "id").limit(limit)
            hits, order = rows.select("id", "date_sent", none("double").alias("score"), none("int").alias("kw_rank"), none("int").alias("vec_rank"), none("long").alias("chunk_id")), [F.col("date_sent").desc_nulls_last(), "id"]
        elif mode == "keyword":
            found = keyword.search(self.messages, query, limit, kept, self.index, self.analyser)
            hits, order = vectors.ranked(found, ["score", "id"], "kw_rank").select("id", "score", "kw_rank", none("int").alias("vec_rank"), none("long").alias("chunk_id")), ["kw_rank"]
        elif mode == "semantic":
            near = vectors.semantic_search(self.vectors(), kept, self._query_vector(query), limit)
            hits, order = vectors.ranked(near, ["distance", "chunk_id"], "vec_rank").select(F.col("message_id").alias("id"), F.col("distance").alias("score"), none("int").alias("kw_rank"), "vec_rank", "chunk_id"), ["vec_rank"]
        else:
            hits = fusion.hybrid_search(self.messages, kept, self.vectors(), query, self._query_vector(query), limit, self.index, self.analyser)
            order = [F.col("score").desc(), F.col("kw_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last(), "id"]
        return self._shaped(vectors.ranked(hits, order, "rank"), query)

    def _shaped(self, hits: DataFrame, query: str) -> DataFrame:
        """Hits with what is shown of them; the snippet is of the column that shows most of the words found, else the chunk's, else the body's start."""
        analyser = self.index.analyser if self.index else self.analyser
        tree = keyword.parse_query(query, analyser)
        term_of = (lambda w: "".join(parsing.porter_tokens(w))) if analyser == "porter" else str.lower
        cells = [f for f in keyword.FIELDS if f in self.messages.columns]
        phrases = keyword.snippet_phrases(tree, cells) if tree is not None else []
        attached = "attachment_id" in self.chunks.columns and "attachments" in self.tables
        chunk = self.chunks.select(F.col("id").alias("chunk_id"), "chunk_text", *(["attachment_id"] if attached else []))
        rows = F.broadcast(hits.drop("date_sent")).join(self.messages, "id").join(chunk, "chunk_id", "left")
        if attached:
            rows = rows.join(self.attachments.select(F.col("id").alias("attachment_id"), F.col("filename").alias("attachment")), "attachment_id", "left")
        else:
            rows = rows.withColumn("attachment", F.lit(None).cast("string"))
        worded = parsing.column(lambda found, *texts: parsing.best_snippet(list(texts), phrases, term_of=term_of) if found else None, "string", F.col("kw_rank").isNotNull(), *cells)
        shown = F.coalesce(worded, text.truncate(F.col("chunk_text"), fusion.SNIPPET), text.snippet(F.col("body_text"), fusion.SNIPPET))
        return rows.select("rank", "id", "message_id", "folder", "subject", "from_address", "from_name", "date_sent", shown.alias("snippet"), "score", "kw_rank", "vec_rank", "attachment").orderBy("rank")

    def get_message(self, key: int | str) -> DataFrame:
        return archive.message_with_attachments(self.messages, self.attachments, "id" if isinstance(key, int) else "message_id", key)

    def get_thread(self, message: int, max_messages: int = archive.THREAD_MESSAGES, max_chars: int = archive.THREAD_CHARS) -> DataFrame:
        rows = archive.thread_of(self.messages, message).withColumn("_thread", F.lit(1))
        out = archive.body_budget(rows, "_thread", [F.col("date_sent").asc_nulls_last(), F.col("id")], max_messages, max_chars)
        return out.select("id", "message_id", "subject", "from_address", "date_sent", "body", text.snippet(F.col("body_text"), 200).alias("snippet"))

    def folders(self) -> DataFrame:
        return archive.folder_stats(self.messages, self.sync_state)

    def attachment_text(self, attachment: int, offset: int = 0, window: int = PAGE_DEFAULT) -> DataFrame:
        """A page of an attachment's text and how long the whole is."""
        n = max(1, min(window, PAGE_MAX))
        return self.attachments.filter(F.col("id") == attachment).select("id", "filename", F.substring("extracted_text", max(0, offset) + 1, n).alias("page"), F.char_length("extracted_text").alias("total"))

    # --- upkeep ---
    def build_index(self, path: str) -> Archive:
        self.index = KeywordIndex.build(self.messages, path, self.analyser)
        return self

    def rebuild_bodies(self) -> DataFrame:
        """Messages with their text derived anew from HTML where there is some."""
        fresh = parsing.column(lambda h, b: parsing.html_to_text(h) if h else b, "string", "body_html", "body_text")
        return self.messages.withColumn("body_text", fresh)

    def purge(self, before: dt.datetime) -> dict[str, DataFrame]:
        children = {"attachments": (self.attachments, "message_id"), "chunks": (self.chunks, "message_id")}
        kept, rest = ingest.purge(self.messages, children, F.lit(before).cast("timestamp_ntz"))
        return {"messages": kept, **rest}

    def status(self) -> DataFrame:
        return archive.pipeline_counts(self.messages, self.chunks)

    def doctor(self) -> DataFrame:
        """(check, state, detail) of what can be told from the tables, each ok, warn or fail."""
        v = self.vectors()
        bad = v.filter(vectors.audit_class(F.col("embedding")) != "ok")
        orphans = ingest.orphans(self.chunks, self.messages, "message_id", "id")
        cover = archive.coverage(self.messages)
        one = lambda name, df, worse: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "ok").otherwise(worse).alias("state"), F.col("n").cast("string").alias("detail"))
        out = one("vectors", bad, "fail").unionByName(one("orphaned chunks", orphans, "fail"))
        out = out.unionByName(cover.select(F.lit("coverage").alias("check"), F.when(F.col("backlog") == 0, "ok").otherwise("warn").alias("state"), F.col("pct").cast("string").alias("detail")))
        pending = ocr.counts(self.attachments).select((F.col("pdf_pending") + F.col("image_pending")).alias("n"))
        return out.unionByName(pending.select(F.lit("transcription").alias("check"), F.when(F.col("n") == 0, "ok").otherwise("warn").alias("state"), F.col("n").cast("string").alias("detail")))

    # --- quality ---
    def _answers(self, queries: list[dict], mode: str, k: int) -> DataFrame:
        """(query_id, message_id, rank) of many queries: those with the same filters go as blocks, in one pass a leg."""
        if mode not in MODES:
            raise ValueError(f"the mode is one of {', '.join(MODES)}")
        analyser = self.index.analyser if self.index else self.analyser
        groups: dict[SearchFilters, list[dict]] = {}
        for q in queries:
            f = SearchFilters(q.get("folder"), parse_date(q.get("date_from")), parse_date(q.get("date_to"), True), q.get("from_contains"), q.get("from_exact"))
            groups.setdefault(f, []).append(q)
        out = self.spark.createDataFrame([], "query_id string, message_id string, rank int")
        for f, asked in groups.items():
            kept = apply_filters(live(self.messages), f, self.tables.get("attachments"), self.tables.get("sync_state"))
            worded = [q for q in asked if q["query"].strip()]
            depth = fusion.LEG if mode == "hybrid" else k
            if mode != "semantic":
                trees = {q["query_id"]: keyword.parse_query(q["query"], analyser) for q in worded}
                kw = batch_search.keyword_block(self.messages, trees, depth, kept, self.index, self.analyser)
            if mode != "keyword" and worded:
                vectors_of = {q["query_id"]: self._query_vector(q["query"]).first().q for q in worded[:1]}
                vectors_of |= {q["query_id"]: self.embed(q["query"]) for q in worded[1:]}
                vec = batch_search.semantic_block(self.vectors(), kept, vectors_of, depth)
            if not worded:
                hits = None
            elif mode == "keyword":
                hits = kw.select("query_id", "id", F.col("kw_rank").alias("rank"))
            elif mode == "semantic":
                hits = vec.select("query_id", F.col("message_id").alias("id"), F.col("vec_rank").alias("rank"))
            else:
                hits = batch_search.hybrid_block(kw, vec, k).select("query_id", "id", "rank")
            if hits is not None:
                out = out.unionByName(F.broadcast(hits).join(self.messages.select("id", "message_id"), "id").select("query_id", "message_id", "rank"))
            for q in asked:
                if not q["query"].strip():  # browsing has no words to share
                    out = out.unionByName(self.search("", mode, f, k).select(F.lit(q["query_id"]).alias("query_id"), "message_id", "rank"))
        return out

    def evaluate(self, queries: list[dict], mode: str = "hybrid", k: int = 10) -> dict[str, DataFrame]:
        """Ranks, NDCG, MRR, recall and specificity of a labelled query set in one mode."""
        rows, gold = self._answers(queries, mode, k), []
        for q in queries:
            gold += [(q["query_id"], g["message_id"], g["grade"]) for g in q["relevant"]]
        qrels = self.spark.createDataFrame(gold, schemas.QRELS)
        return {"ranked": rows, "ndcg": evalkit.ndcg(rows, qrels, k), "mrr": evalkit.mrr(rows, qrels, k), "recall": evalkit.recall(rows, qrels, k), "specificity": evalkit.specificity(rows, qrels, k)}
