"""The archive's tables over the test tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.session import spread

TABLES = {
    "messages": """
select d.doc_id as id, cast(d.doc_id as string) || '@docs' as message_id,
  case when d.doc_id % 9 = 0 then null else cast(d.doc_id - d.doc_id % 5 as string) || '@docs' end as thread_id,
  d.source as folder, '/mail/' || d.source || '/cur' as maildir_path, cast(d.doc_id as string) || '.eml' as maildir_filename,
  replace(substr(d.text, 1, 60), chr(10), ' ') as subject,
  'user' || cast(e.user_id as string) || '@' || d.lang || '.example' as from_address,
  case when d.doc_id % 4 = 0 then null else 'User_' || cast(e.user_id as string) end as from_name,
  case when d.doc_id % 37 = 0 then null else e.ts end as date_sent,
  case when d.doc_id % 23 = 0 then e.ts end as deleted_at,
  case when d.doc_id % 7 = 0 then null else e.ts end as embedded_at,
  e.ts as indexed_at, d.doc_id % 3 = 0 as has_attachments, d.text as body_text, cast(d.n_chars as bigint) as size_bytes,
  md5(d.text) as content_hash, d.doc_id % 3 as embed_epoch, d.lang as lang
from {documents} d left join {events} e on e.event_id = d.doc_id""",
    "attachments": """
select d.doc_id * 2 + p.part as id, d.doc_id as message_id, cast(p.part as int) as part_index,
  case (d.doc_id + p.part) % 8 when 0 then 'scan.pdf' when 1 then 'shot.png' when 2 then 'photo.jpg' when 3 then 'anim.gif'
    when 4 then 'notes.docx' when 5 then 'meet.ics' when 6 then 'page.tiff' else 'readme.txt' end as filename,
  case (d.doc_id + p.part) % 8 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'application/octet-stream'
    when 3 then 'image/gif' when 4 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    when 5 then 'text/plain' when 6 then null else 'text/plain' end as content_type,
  case (d.doc_id + p.part * 3) % 8 when 0 then 'done' when 1 then 'failed' when 2 then 'no_text' when 3 then 'oversize'
    when 4 then 'unsupported' when 5 then 'encrypted' when 6 then 'ocr' else null end as extraction_status,
  case when d.doc_id % 5 = 0 then null else d.text || ' part ' || cast(p.part as string) end as extracted_text,
  cast(d.n_chars * 40 + p.part as bigint) as size_bytes,
  case when (d.doc_id + p.part * 3) % 8 = 6 and d.doc_id % 2 = 0 then 'vision-a' end as ocr_model, e.ts as extracted_at
from {documents} d left join {events} e on e.event_id = d.doc_id
cross join (select 0 as part union all select 1 as part) p
where d.doc_id % 3 = 0 and p.part <= d.doc_id % 2""",
    "sync_state": """
select '/mail/' || d.source || '/cur/' || cast(d.doc_id as string) as maildir_full_path, cast(d.doc_id as string) || '@docs' as message_id,
  case when d.doc_id % 11 = 0 then null else d.source end as folder, e.ts as last_seen_at,
  case when d.doc_id % 13 = 0 then null else md5(d.text) end as content_hash, cast(d.n_chars as bigint) as file_size, e.ts as file_mtime_utc
from {documents} d left join {events} e on e.event_id = d.doc_id
union all
select '/mail/src' || cast((d.doc_id + 7) % 20 as string) || '/cur/' || cast(d.doc_id as string), cast(d.doc_id as string) || '@docs',
  case when d.doc_id % 11 = 0 then null else 'src' || cast((d.doc_id + 7) % 20 as string) end, e.ts, md5(d.text), cast(d.n_chars as bigint), e.ts
from {documents} d left join {events} e on e.event_id = d.doc_id where d.doc_id % 5 = 0""",
    "chunks": """
select v.vec_id as id, v.vec_id % 200 as message_id, cast(floor(v.vec_id / 200) as int) as chunk_index,
  'chunk ' || cast(v.vec_id as string) as chunk_text, v.embedding as embedding,
  case when (v.vec_id % 200) % 3 = 0 and v.vec_id % 2 = 1 then 'attachment' else 'body' end as source,
  case when (v.vec_id % 200) % 3 = 0 and v.vec_id % 2 = 1 then (v.vec_id % 200) * 2 end as attachment_id
from {embeddings} v""",
    # Every 97th document is relevant to an item, or one place beside it.
    "qrels": """
select 'q' || cast(b.item_id as string) as query_id, cast(d.doc_id as string) || '@docs' as message_id,
  cast(1 + coalesce(l.quality, 0) as double) as grade
from {benchmark} b join {documents} d on d.doc_id % 97 = b.item_id left join {labels} l on l.doc_id = d.doc_id""",
    "ranked": """
select 'q' || cast(item_id as string) as query_id, cast(doc_id as string) || '@docs' as message_id, rank, elapsed_ms, mode from (
  select b.item_id, b.item_id + 97 * (k.k % 3) + case when (b.item_id + k.k) % 4 = 0 then 1 else 0 end as doc_id, k.k as rank,
    cast(b.item_id % 17 * 3 + 1 as double) as elapsed_ms, 'keyword' as mode
  from {benchmark} b cross join (select 1 as k union all select 2 union all select 3) k
  union all select b.item_id, d.doc_id, 2 + b.item_id % 3, cast(b.item_id % 11 + 2 as double), 'semantic' from {benchmark} b join {documents} d on d.doc_id = b.item_id) x""",
    # A document's whole text in pages of 400 characters, each read by three engines.
    "ocr_pages": """
select engine, attachment_id, page, reference, case when k = 0 then reference when (attachment_id + page) % 25 = 3 then ' '
    when k = 1 then replace(reference, 'e', 'c') else replace(replace(reference, 'an', 'am'), ' the ', ' ') end as hypothesis,
  cast((attachment_id + page) % 13 + k * 5 as double) as elapsed_ms, case when (attachment_id + page + k) % 10 = 9 then 'timeout' end as error
from (select e.k as k, case e.k when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as engine, d.doc_id as attachment_id, p.page as page,
    substr(d.text, cast((p.page - 1) * 400 + 1 as int), 400) as reference
  from (select doc_id, text, cast(greatest(1, ceil(length(text) / 400.0)) as int) as n from {documents}) d
  SERIES(d.n) p cross join (select 0 as k union all select 1 union all select 2) e) x""",
}
#: Numbers from 1 to n beside each row, for which engines have no common word.
SERIES = {"spark": "cross join lateral (select explode(sequence(1, {0})) as page)", "sql": "cross join lateral (select unnest(generate_series(1, {0})) as page)"}
BASE = ("documents", "events", "embeddings", "benchmark", "labels", "pages", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(name: str, engine: str) -> str:
    return re.sub(r"SERIES\(([\w.]+)\)", lambda m: SERIES[engine].format(m[1]), TABLES[name])


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """An archive table, or a base table by its own name; wide spreads texts over the cores, for what works hard on them."""
    read = lambda b: spread(base(spark, sf_dir, b)) if wide and b in ("documents", "pages") else base(spark, sf_dir, b)
    if name in BASE:
        return read(name)
    sql = _written(name, "spark")
    return spark.sql(sql, **{b: read(b) for b in BASE if "{" + b + "}" in sql})


def ctes(*names: str) -> str:
    """The same tables as a WITH clause."""
    return "with " + ", ".join(f"{n} as ({_written(n, 'sql').format(**{b: b for b in BASE})})" for n in names)
