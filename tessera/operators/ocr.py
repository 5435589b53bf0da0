"""The transcription queue: candidates, verdicts, resets, provenance, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import attachment_kinds as kinds

MIN_IMAGE_BYTES, MIN_EDGE, MAX_ASPECT, TEXT_FLOOR = 51_200, 200, 8.0, 10
MAX_ATTEMPTS, MAX_FETCH = 5, 256
CT, NAME, STATUS = "content_type", "filename", "extraction_status"


def pdf() -> Column:
    return F.coalesce(kinds.is_pdf(F.col(CT), F.col(NAME)), F.lit(False))


def image() -> Column:
    return F.coalesce(kinds.is_readable_image(F.col(CT), F.col(NAME)), F.lit(False))


def backfillable() -> Column:
    return (F.col(STATUS) == "ocr") | (image() & (F.col(STATUS) == "no_text"))


def _of_live(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    return attachments.join(messages.filter("deleted_at is null").select(F.col("id").alias("_m")), F.col("message_id") == F.col("_m"), "left_semi")


def page(rows: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """The next page by key."""
    return rows.filter(F.col(key) > cursor).orderBy(key).limit(size)


def next_page(rows: DataFrame, key: str, cursor: int, size: int, backing_off: DataFrame, cycle: int) -> DataFrame:
    """(key, attempt): the candidates that a step of the sweep examines, in order; the largest key is the next cursor.

    backing_off (key, until) are candidates not to be read before a cycle. They have had their turn and are passed over, and so
    many more are fetched, MAX_FETCH at most, that `size` can be attempted. What is fetched beyond that is not examined.
    Past the last candidate the sweep begins again, once.
    """
    waiting = backing_off.filter(F.col("until") > cycle).select(key).distinct()
    fetch = min(MAX_FETCH, size + backing_off.count())
    fetched = page(rows.select(key), key, cursor, fetch)
    if cursor and fetched.isEmpty():
        fetched = page(rows.select(key), key, 0, fetch)
    marked = fetched.join(waiting.withColumn("_waits", F.lit(True)), key, "left").withColumn("attempt", F.col("_waits").isNull())
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # of MAX_FETCH rows
    done = F.coalesce(F.count_if("attempt").over(before), F.lit(0))
    return marked.withColumn("_done", done).filter(F.col("_done") < size).select(key, "attempt")


def failure_action(kind: Column) -> Column:
    """What a failed reading means: the batch is broken off, the document retired at once, or the failure counted."""
    return F.when(kind.isin("backpressure", "auth_or_config"), "abort_batch").when(kind == "document_fatal", "retire").otherwise("count")


def retirements(attempts: DataFrame, key: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, counted, retired) from attempts (key, cycle, kind), kind null for a success, and probe_ok where a cycle was probed.

    A failure counts only in a cycle that shows that the model can run, by a success or a probe: else a broken model would
    retire every document. What asks to slow down or is refused for its credentials says nothing about the document.
    """
    tried = attempts.withColumn("_does", F.when(F.col("kind").isNotNull(), failure_action(F.col("kind"))))
    healthy = tried.groupBy("cycle").agg((F.count_if(F.col("kind").isNull() | F.coalesce("probe_ok", F.lit(False))) > 0).alias("_healthy"))
    counted = F.count_if((F.col("_does") == "count") & F.col("_healthy"))
    out = tried.join(healthy, "cycle").groupBy(key).agg(counted.alias("counted"), (F.count_if(F.col("_does") == "retire") > 0).alias("_fatal"))
    return out.select(key, "counted", (F.col("_fatal") | (F.col("counted") >= most)).alias("retired"))


def pdf_candidates(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """PDFs in which no text was found."""
    return _of_live(attachments, messages).filter(pdf() & (F.col(STATUS) == "no_text"))


def image_candidates(attachments: DataFrame, messages: DataFrame, min_bytes: int = MIN_IMAGE_BYTES) -> DataFrame:
    """Images of some size that nothing has read yet."""
    return _of_live(attachments, messages).filter(image() & (F.col(STATUS).isNull() | (F.col(STATUS) == "unsupported")) & (F.col("size_bytes") >= min_bytes))


def reset_candidates(attachments: DataFrame, messages: DataFrame, engine: str | None = None) -> DataFrame:
    """Verdicts that could be taken back, with the status they would go to; engine 'unknown' is none recorded."""
    rows = attachments.join(messages.filter("deleted_at is null").select(F.col("id").alias("_m"), "date_sent"), F.col("message_id") == F.col("_m")).filter(backfillable()).drop("_m")
    if engine == "unknown":
        rows = rows.filter("ocr_model is null")
    elif engine:
        rows = rows.filter(F.col("ocr_model") == engine)
    return rows.withColumn("target", F.when(pdf(), "no_text").otherwise("unsupported"))


def apply_verdict(attachments: DataFrame, staged: DataFrame) -> DataFrame:
    """(id, status, text, outcome): staged (id, expected, text) take effect where the status is still the expected one.

    Blank text is final and leaves nothing to embed; a row that has moved on is stale.
    """
    s = staged.select(F.col("id").alias("_id"), F.col("expected"), F.col("text").alias("_text"))
    rows = attachments.join(s, F.col("id") == F.col("_id"))
    hit, blank = F.col(STATUS).eqNullSafe(F.col("expected")), F.char_length(F.trim(F.coalesce("_text", F.lit("")))) < TEXT_FLOOR
    return rows.select("id", "message_id", F.when(~hit, F.col(STATUS)).when(blank, "no_text").otherwise("ocr").alias("status"), F.when(hit & ~blank, F.col("_text")).otherwise(F.col("extracted_text")).alias("text"), F.when(~hit, "stale").when(blank, "empty").otherwise("saved").alias("outcome"))


def image_gate(width: Column, height: Column) -> Column:
    short, long = F.least(width, height), F.greatest(width, height)
    return F.when(short < MIN_EDGE, "too_small").when(long > short * MAX_ASPECT, "too_narrow").otherwise("ok")


def counts(attachments: DataFrame) -> DataFrame:
    return attachments.agg(
        F.count_if(pdf() & (F.col(STATUS) == "no_text")).alias("pdf_pending"), F.count_if(image() & (F.col(STATUS).isNull() | (F.col(STATUS) == "unsupported"))).alias("image_pending"),
        F.count_if(F.col(STATUS) == "ocr").alias("done"), F.count_if((image() | pdf()) & (F.col(STATUS) == "failed")).alias("failed"), F.count_if(image() & (F.col(STATUS) == "no_text")).alias("image_empty"),
    )
