"""Search filters: one builder for keyword, vector and browse queries."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import attachment_kinds as kinds

DEFAULT_LIMIT, MAX_LIMIT = 20, 100


@dataclass(frozen=True)
class SearchFilters:
    folder: str | None = None
    date_from: dt.datetime | None = None
    date_to: dt.datetime | None = None
    from_contains: str | None = None
    from_exact: str | None = None
    has_attachments: bool | None = None
    attachment_type: str | None = None

    @property
    def is_empty(self) -> bool:
        return all(v is None or v == "" for v in vars(self).values())


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit < 1 else min(limit, MAX_LIMIT)


def parse_date(value: str | None, upper: bool = False) -> dt.datetime | None:
    """A bound in UTC; a date alone as an upper bound is the end of its day; ValueError for what is no date."""
    if value is None or not value.strip():
        return None
    value = value.strip()
    if len(value) == 10:
        day = dt.datetime.combine(dt.date.fromisoformat(value), dt.time())
        return day + dt.timedelta(days=1) - dt.timedelta(microseconds=1) if upper else day
    when = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    return when.astimezone(dt.UTC).replace(tzinfo=None) if when.tzinfo else when


def live(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("deleted_at").isNull())


def apply_filters(messages: DataFrame, f: SearchFilters, attachments: DataFrame | None = None, sync_state: DataFrame | None = None) -> DataFrame:
    """Messages that pass all filters. Folder and attachment filters are semi joins, whose right sides are pruned to keys."""
    out = messages
    if f.folder:
        own = F.col("folder") == f.folder
        if sync_state is None:
            out = out.filter(own)
        else:
            copies = sync_state.filter(F.col("folder") == f.folder).select(F.col("message_id").alias("_copy")).distinct()
            out = out.join(copies, F.col("message_id") == F.col("_copy"), "left").filter(own | F.col("_copy").isNotNull()).drop("_copy")
    second = lambda when: F.lit(when.replace(microsecond=0)).cast("timestamp_ntz")
    if f.date_from:
        out = out.filter(F.date_trunc("second", "date_sent") >= second(f.date_from))
    if f.date_to:
        out = out.filter(F.date_trunc("second", "date_sent") <= second(f.date_to))
    if f.has_attachments is not None:
        out = out.filter(F.col("has_attachments") == f.has_attachments)
    if f.attachment_type:
        kind = f.attachment_type.lower().lstrip(".")
        ct, name = F.col("content_type"), F.col("filename")
        if kind == "image":
            fits = F.lower(ct).startswith("image/") | kinds.ends_with_any(name, kinds.FILTER_IMAGES)
        else:
            fits = F.lower(name).endswith("." + kind)
            if mime := kinds.MIME_BY_EXTENSION.get("." + kind):
                fits = fits | (F.lower(ct) == mime)
        out = out.join(attachments.filter(fits).select(F.col("message_id").alias("_m")), F.col("id") == F.col("_m"), "left_semi")
    if f.from_exact:
        out = out.filter(F.lower("from_address") == f.from_exact.lower())
    elif f.from_contains:
        want = f.from_contains.lower()
        out = out.filter(F.lower("from_address").contains(want) | F.coalesce(F.lower("from_name").contains(want), F.lit(False)))
    return out
