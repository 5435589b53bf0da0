"""Periodic runs of words, by a vectorised scan of all lags.

A run is a stretch of words with smallest period q, at least `min_exp` periods and `min_len` words long, that no
neighbouring word extends. A text becomes an array of word numbers, which is compared with itself shifted by every lag q
up to n / min_exp; a run of period q is a stretch of (min_exp - 1) q true comparisons or more.

Each lag is compared in two steps. First at every q-th word, all lags of a block in one pass: a stretch that is long enough
holds min_exp - 1 of those in a row. That takes n / q comparisons, n log n for all lags. Then, around what is left, at
every word, where the lengths of true stretches are taken. What repeats with a multiple of its period is passed by: it lies in
a run already found, and such a run is then the whole stretch.

Texts up to LONG_BYTES are worked on where they are. A longer text is cut into ranges of lags of about WORK comparisons,
which Spark deals out; its word numbers go with each, and so do the runs of the first lags. Their runs come
together by the text's digest, so copies are scanned once.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. A null or repeated id is a row
like any other. Texts without runs come back with their words joined by one space. An empty table gives an empty
table. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.scratch import Scratch
from tessera.llm.words import slices, word_lists

#: Comparisons in one vectorised pass, and in one range of lags of a long text.
SIEVE, WORK = 1 << 18, 1 << 25
#: Bytes of a text over which its lags are dealt out; lags that are scanned before that.
LONG_BYTES, FIRST_LAGS = 16 << 20, 4096

Run = tuple[int, int, int]


class _Codes(dict):
    """word -> number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def word_numbers(text: str | None) -> np.ndarray:
    codes = _Codes()
    parts = [np.fromiter(map(codes.__getitem__, words), np.int32, len(words)) for words in word_lists(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def lag_blocks(n: int, low: int, high: int, most: int) -> Iterator[tuple[int, int]]:
    """Lags low .. high - 1 in blocks of about `most` comparisons, one lag at least."""
    while low < high:
        end = low + 1
        while end < high and (n // low) * (end - low) < most:
            end = min(high, low + 2 * (end - low))
        yield low, end
        low = end


def _sifted(ids: np.ndarray, low: int, high: int, need: int) -> Iterator[tuple[int, int, int]]:
    """(lag, first, last): words at multiples of the lag, `need` or more in a row, that equal those a lag further."""
    n = len(ids)
    for a, b in lag_blocks(n, low, high, SIEVE):
        if b == a + 1:
            equal = ids[: n - a : a] == ids[a::a]
            lags, places = np.full(len(equal), a), np.arange(0, n - a, a)
        else:
            lag = np.arange(a, b)
            size = (n - 1) // lag
            lags = np.repeat(lag, size)
            places = lags * (np.arange(len(lags)) - np.repeat(np.cumsum(size) - size, size))
            equal = ids[places] == ids[places + lags]
        if len(equal) < need:
            continue
        row = lags[need - 1 :] == lags[: len(lags) - need + 1]
        for k in range(need):
            row &= equal[k : len(equal) - need + 1 + k]
        hit = np.flatnonzero(row)
        if not len(hit):
            continue
        parts = np.flatnonzero((np.diff(hit) > 1) | (np.diff(lags[hit]) != 0))
        first, last = hit[np.append(0, parts + 1)], hit[np.append(parts, len(hit) - 1)] + need - 1
        yield from zip(lags[first].tolist(), places[first].tolist(), places[last].tolist(), strict=True)


def scan_lags(ids: np.ndarray, low: int, high: int, min_exp: int = 4, min_len: int = 6, known: list[Run] | None = None) -> list[Run]:
    """Runs (start, length, period) with a period of low .. high - 1, given those (known) of smaller periods.

    A stretch whose smallest period is in neither comes with a multiple of it; primitive() takes those out.
    """
    if min_exp < 3 or int(min_exp) != min_exp:
        raise ValueError("min_exp is a whole number of at least 3")
    n, out = len(ids), []
    begins: dict[int, list[int]] = {}  # by period, in ascending order as runs are found
    ends: dict[int, list[int]] = {}

    def put(run: Run) -> None:
        begins.setdefault(run[2], []).append(run[0])
        ends.setdefault(run[2], []).append(run[0] + run[1])

    for run in sorted(known or []):
        put(run)

    def inside(lag: int, first: int, end: int) -> bool:
        """Whether the words first .. end lie in a run whose period divides the lag."""
        for period, starts in begins.items():
            if lag % period == 0 and (k := bisect_right(starts, first)) and ends[period][k - 1] >= end:
                return True
        return False

    for q, first, last in _sifted(ids, low, min(high, n // min_exp + 1), min_exp - 1):
        if inside(q, first, last + q + 1):
            continue
        a, b = max(first - q + 1, 0), min(last + q, n - q)
        equal = np.concatenate([[False], ids[a:b] == ids[a + q : b + q], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for s, e in zip((edges[::2] + a).tolist(), (edges[1::2] + a).tolist(), strict=True):
            if e - s >= (min_exp - 1) * q and e - s + q >= min_len and not inside(q, s, e + q):
                put((s, e - s + q, q))
                out.append((s, e - s + q, q))
    return out


def primitive(runs: list[Run]) -> list[Run]:
    """Of runs over one stretch that with the smallest period; by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def best_run(runs: list[Run]) -> Run | None:
    """The run of the greatest length over period; the first, then that of the smallest period, among equals."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapse(text: str | None, runs: list[Run], n: int) -> str:
    """The words joined by one space, without those that a run has after its first period."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep, at, parts = np.cumsum(drop)[:n] == 0, 0, []
    for words in word_lists(text):
        kept = [w for w, k in zip(words, keep[at : at + len(words)].tolist(), strict=True) if k]
        at += len(words)
        if kept:
            parts.append(b" ".join(kept))
    return b" ".join(parts).decode("utf-8", "surrogatepass")


RUN = "struct<start:long,length:long,period:long>"
COLUMNS = f"n_words long, runs array<{RUN}>, best {RUN}, kept_text string"


def _structs(runs: list[Run | None]) -> pa.StructArray:
    columns = zip(*(r or (0, 0, 0) for r in runs), strict=True) if runs else ([], [], [])
    mask = pa.array([r is None for r in runs], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"], mask=mask)


def _results(ids: pa.Array, found: list[tuple[int, list[Run], str]], kinds: pa.Schema) -> pa.RecordBatch:
    offsets = np.cumsum([0] + [len(runs) for _, runs, _ in found])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs([r for _, some, _ in found for r in some]))
    best = _structs([best_run(runs) for _, runs, _ in found])
    columns = [ids, pa.array([n for n, _, _ in found], pa.int64()), runs, best, pa.array([t for _, _, t in found], pa.string())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def _whole(min_exp: int, min_len: int, kinds: pa.Schema):
    """(id, text) -> results, all lags of a text in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = []
            for cell in batch.column(1):
                ids = word_numbers(text := cell.as_py())
                runs = primitive(scan_lags(ids, 1, len(ids), min_exp, min_len)) if len(ids) >= min_len else []
                found.append((len(ids), runs, collapse(text, runs, len(ids))))
            yield _results(batch.column(0), found, kinds)

    return run


def _ranges(min_exp: int, min_len: int, work: int, first: int):
    """(key, text) -> (key, low, high, ids, known): the runs of the first lags as a row of their own, the rest of the lags in ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = word_numbers(text.as_py())
                last = len(ids) // min_exp + 1
                known = scan_lags(ids, 1, min(first, last), min_exp, min_len)
                packed = np.array(known, np.int64).reshape(-1, 3).tobytes()
                for low, high in [(0, 0), *lag_blocks(len(ids), min(first, last), last, work)]:
                    columns = [pa.array([key.as_py()], pa.binary()), pa.array([low], pa.int64()), pa.array([high], pa.int64())]
                    columns += [pa.array([ids.tobytes() if high else b""], pa.binary()), pa.array([packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "low", "high", "ids", "known"])

    return run


def _range_runs(min_exp: int, min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, low, high, ids, known in zip(*(c for c in batch.columns), strict=True):
                runs = [tuple(r) for r in np.frombuffer(known.as_py(), np.int64).reshape(-1, 3).tolist()]
                if high.as_py():
                    runs = scan_lags(np.frombuffer(ids.as_py(), np.int32), low.as_py(), high.as_py(), min_exp, min_len, runs)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(runs), pa.binary()), _structs(runs)], ["key", "run"])

    return run


def _gathered(kinds: pa.Schema):
    """(id, text, runs) -> results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n = sum(map(len, word_lists(text.as_py())))
                some = primitive([(r["start"], r["length"], r["period"]) for r in runs or []])
                found.append((n, some, collapse(text.as_py(), some, n)))
            yield _results(batch.column(0), found, kinds)

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exp: int = 4, min_len: int = 6,
    long_bytes: int = LONG_BYTES, work: int = WORK, first_lags: int = FIRST_LAGS,
) -> DataFrame:
    """(id_col, n_words, runs, best, kept_text) of every row; runs by start, then period."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"], *StructType.fromDDL(COLUMNS).fields])
    kinds = to_arrow_schema(schema)
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    out = rows.filter(~is_long).mapInArrow(_whole(min_exp, min_len, kinds), schema)
    long = rows.filter(is_long)
    if not long.isEmpty():
        scratch = Scratch(docs.sparkSession, "periodic")
        key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")
        texts = long.select(key, "text").groupBy("key").agg(F.first("text").alias("text"))
        ranges = scratch.keep(texts.mapInArrow(_ranges(min_exp, min_len, work, max(2, first_lags)), "key binary, low long, high long, ids binary, known binary"), "ranges")
        dealt = ranges.repartition(max(1, min(ranges.count(), 50_000)), "key", "low")
        runs = dealt.mapInArrow(_range_runs(min_exp, min_len), f"key binary, run {RUN}").distinct()
        runs = scratch.keep(runs.groupBy("key").agg(F.collect_list("run").alias("runs")), "runs")  # a text's runs, bounded by its words
        joined = long.select("id", "text", key).join(runs, "key", "left")
        out = out.unionByName(joined.select("id", "text", "runs").mapInArrow(_gathered(kinds), schema))
    return out.withColumnRenamed("id", id_col)


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col): of a tenth of the ids, by their hash, the text's tail is made periodic."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    plain = docs.select(id_col, text_col)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    # Step by step, so that a text is cut into words once.
    words = F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = plain.filter(chosen).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), words.alias("w"), ((h - h % 10) / 10).cast("long").alias("g"))
    cut = cut.select("id", "text", "w", "g", F.size("w").alias("n")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    cut = cut.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast(ceil((n - a) / p) as int)"))), F.lit(1), F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    changed = cut.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias(text_col))
    return changed.unionByName(plain.filter(~chosen))  # else all texts would be cut into words for a tenth


def digest_runs(runs: Column) -> Column:
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), 256)



#: The ids' crc32 is folded bit by bit; then each lag at its multiples, and word by word where three of those in a row are equal.
ORACLE = r"""
with h as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) as h from documents),
g as (select doc_id, w, len(w)::bigint as n, h % 10 = 0 and len(w) > 0 as made, h // 10 as g from h),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from (select *, case when n > 0 then g % n else 0 end as a from g)),
t as materialized (select doc_id, n, i, case when made and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as w from (select *, unnest(range(n)) as i from p)),
sizes as (select doc_id, max(n) as n from t group by doc_id),
lags as (select doc_id, n, unnest(range(1, n // 4 + 1)) as q from sizes),
multiples as (select doc_id, q, unnest(range((n - 1) // q)) as j from lags),
same as (select m.doc_id, q, j from multiples m join t a on a.doc_id = m.doc_id and a.i = q * j join t b on b.doc_id = m.doc_id and b.i = q * (j + 1) where a.w = b.w),
rows_of as (select doc_id, q, min(j) * q as first, max(j) * q as last from (select *, j - row_number() over (partition by doc_id, q order by j) as part from same) group by doc_id, q, part having count(*) >= 3),
near as (select r.doc_id, q, first, unnest(range(greatest(first - q + 1, 0), least(last + q, n - q))) as i from rows_of r join sizes using (doc_id)),
equal as (select x.doc_id, x.q, x.first, x.i from near x join t a on a.doc_id = x.doc_id and a.i = x.i join t b on b.doc_id = x.doc_id and b.i = x.i + x.q where a.w = b.w),
stretches as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q, first order by i) as part from equal) group by doc_id, q, first, part having count(*) >= 3 * q and count(*) + q >= 6),
runs as materialized (select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length),
best as (select doc_id, start, length, period from runs qualify row_number() over (partition by doc_id order by length / period::double desc, start, period) = 1),
said as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(w, ' ' order by i) as kept from t anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
  sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from documents d left join best using (doc_id) left join said using (doc_id) left join kept using (doc_id)
"""
