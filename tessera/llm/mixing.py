"""Mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated per source (partial sums before the shuffle), a target is set for each source, and a document is
emitted floor(rate) times plus one copy where a hash of seed and id, read as a number in [0, 1), is under the fraction.
The hash makes reruns and retried tasks agree.

Targets: sources by code point, null last, weigh `weights` in turn and share `share` times all tokens; a target stops at
`limit` times the source's tokens and what is over is shared again by weight. That is target = min(limit * tokens,
level * weight) with one level for all, found in one pass over the sources in the order in which they reach their limit.

Up to BROADCAST sources, a counted bound, one narrow row for each is ordered by one task and the rates are broadcast. Beyond
it sources are ordered by ranges, whose sums are carried from one to the next, and documents are joined by source and salt.

Defined results: a null or empty text has size 0 and is emitted floor(rate) times or once more like any other, for no words. A null source is a source
of its own, last. A source without tokens has target 0 and rate 0. Where an id is null or repeats, rows are drawn by their id, their
text and their place among the rows that have both, so that equal rows are drawn apart; for that the rows are written once more. An
empty table gives an empty table. Columns of the input whose names clash are inside row; emit() names the copies' number so that it clashes with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

BROADCAST, SALTS = 20_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(rows: DataFrame, order: list[Column], sums: list[str], scratch: Scratch, few: bool) -> DataFrame:
    """rows with place, from 0, and before_<c>, the sum of c over the rows before, in an order."""
    window, offsets = Window.orderBy(*order), None
    if not few:
        rows = scratch.keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
        totals = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_{c}") for c in sums))
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        carried = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_0") for c in ("_rows", *(f"_{c}" for c in sums))]
        offsets, window = totals.select("_range", *carried), Window.partitionBy("_range").orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("place", F.row_number().over(window) - 1)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(before), F.lit(0.0)))
    if offsets is None:
        return out
    out = out.join(F.broadcast(offsets), "_range").withColumn("place", F.col("place") + F.col("_rows_0"))
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"_{c}_0"))
    return out.drop(*offsets.columns)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float, scratch: Scratch, few: bool) -> DataFrame:
    """(source, source_size) -> with target and rate; few: there are no more sources than one task may order."""
    by_name = F.col("source").asc_nulls_last()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    full = _running(sizes, [by_name], [], scratch, few).withColumn("w", w).withColumn("most", F.lit(limit) * F.col("source_size"))
    full = scratch.keep(full.drop("place"), "weights")
    order = [(F.col("most") / F.col("w")).asc(), by_name]
    whole = full.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    # The level if all sources before this one stop at their limit; the first source under its limit at
    # that level sets it, which is the largest such level as they only fall from there.
    level = (F.lit(share) * F.col("all_size") - F.col("before_most")) / (F.col("all_w") - F.col("before_w"))
    levels = _running(full, order, ["most", "w"], scratch, few).join(F.broadcast(whole)).withColumn("level", level)
    levels = scratch.keep(levels.select("source", "source_size", "w", "most", "level"), "levels")
    at = levels.agg(F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).alias("at"))
    target = F.least(F.col("most"), F.coalesce(F.col("at") * F.col("w"), F.col("most")))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return levels.join(F.broadcast(at)).select("source", "source_size", target.alias("target"), rate.alias("rate"))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 32 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """(row, id, size, source_size, target, copies): row is the input row whole, copies how often the mix holds it."""
    scratch = Scratch(docs.sparkSession, "mix")
    size = word_count(F.col(text_col)).alias("size")
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text")
    docs = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), size, F.col(source_col).alias("source"), text)
    key, repeats = F.col("id"), docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
    if not repeats.isEmpty():
        docs = scratch.keep(docs.withColumn("at", F.monotonically_increasing_id()), "rows")
        docs = _running(docs, [F.col("id").asc_nulls_last(), F.col("text"), F.col("at")], [], scratch, few=False)
        key = F.concat_ws(":", F.col("id").cast("string"), F.col("text").cast("string"), F.col("place").cast("string"))
    sizes = scratch.keep(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    few = sizes.count() <= BROADCAST
    rates = scratch.keep(source_targets(sizes, weights, share, limit, scratch, few), "rates").withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    if few:
        joined = docs.join(F.broadcast(rates), same)
    else:
        rates = rates.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)).cast("int")).join(rates, same & (F.col("salt") == F.col("salt2")))
    extra = uniform(seed, key) < F.col("rate") - F.floor("rate")
    copies = (F.floor("rate") + extra.cast("int")).cast("long").alias("copies")
    return joined.select("row", "id", "size", "source_size", "target", copies)


def emit(mixed: DataFrame, copy_col: str = "mix_copy") -> DataFrame:
    """The documents of the mix, each as often as it is taken, and the number of the copy, from 1.

    Where documents have a column copy_col of their own, in any case of letters, it stays and underscores follow the number's name.
    """
    taken = {f.name.lower() for f in mixed.schema["row"].dataType.fields}
    while copy_col.lower() in taken:
        copy_col += "_"
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter("copies > 0").select("row.*", copies.alias(copy_col))


ORACLE = """
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, case (row_number() over (order by encode(source) nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
  2.0::double * source_size as most from sums),
lev as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over b, 0.0::double))
  / (sum(w) over () - coalesce(sum(w) over b, 0.0::double)) as level from w
  window b as (order by most / w, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
lvls as (select *, max(case when level * w <= most then level end) over () as lvl from lev),
tgt as (select source, source_size, least(most, coalesce(lvl * w, most)) as target from lvls),
j as (select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
  from sized s join tgt t on s.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
  size * (floor(rate)::bigint + case when ('0x' || substr(md5('mix:' || doc_id::varchar), 1, 8))::ubigint::double / 4294967296.0::double < rate - floor(rate) then 1 else 0 end) as taken
from j
"""
