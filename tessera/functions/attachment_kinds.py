"""What an attachment is, from its declared type and its name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by file extension.
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".webp": "image/webp", ".svg": "image/svg+xml", ".heic": "image/heic", ".tiff": "image/tiff", ".tif": "image/tiff",
    ".bmp": "image/bmp", ".txt": "text/plain", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html",
    ".xml": "application/xml", ".json": "application/json", ".yaml": "application/yaml", ".yml": "application/yaml",
    ".md": "text/markdown", ".zip": "application/zip",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".ppt": "application/vnd.ms-powerpoint",
    ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".mov": "video/quicktime", ".wav": "audio/wav",
}
# Extensions by content type, for attachments without a name.
EXTENSION_BY_MIME = {
    "application/pdf": ".pdf", "application/zip": ".zip", "application/json": ".json", "application/xml": ".xml", "text/xml": ".xml",
    "text/plain": ".txt", "text/csv": ".csv", "application/csv": ".csv", "application/x-csv": ".csv", "text/html": ".html",
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif",
}
# Extensions that count as images in filters, and those an image reader takes from generic types.
FILTER_IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".heic", ".tiff", ".tif", ".bmp")
READABLE_IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
GENERIC = ("application/octet-stream", "binary/octet-stream")
CALENDAR_TYPES, CALENDAR_EXTENSIONS = ("text/calendar", "application/ics", "application/calendar", "text/x-vcalendar"), (".ics", ".ical", ".vcs")
VCARD_TYPES, VCARD_EXTENSIONS = ("text/vcard", "text/x-vcard", "application/vcard"), (".vcf", ".vcard")
TEXT_EXTENSIONS = (".txt", ".md", ".csv", ".log")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def ends_with_any(name: Column, extensions: tuple[str, ...]) -> Column:
    low = F.lower(name)
    out = low.endswith(extensions[0])
    for e in extensions[1:]:
        out = out | low.endswith(e)
    return out


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]*)$", 1))


def effective_type(content_type: Column, name: Column) -> Column:
    """The declared type, or for generic and missing ones what the extension says."""
    declared = F.when((content_type == "") | content_type.isNull(), F.lit(GENERIC[0])).otherwise(content_type)
    return F.when(F.lower(declared).isin(*GENERIC), F.coalesce(F.try_element_at(_map(MIME_BY_EXTENSION), extension(name)), declared)).otherwise(declared)


def display_name(name: Column, content_type: Column, part: Column) -> Column:
    """The base name, or attachment-<part> with the type's extension."""
    base = F.trim(F.replace(F.regexp_extract(name, r"([^/]*)$", 1), F.lit("\0"), F.lit("_")))
    fallback = F.concat(F.lit("attachment-"), part.cast("string"), F.coalesce(F.try_element_at(_map(EXTENSION_BY_MIME), F.lower(content_type)), F.lit("")))
    return F.coalesce(F.when(base != "", base), fallback)


def attachment_format(content_type: Column, name: Column) -> Column:
    """pdf, docx, xlsx, pptx, calendar, vcard, text or unsupported: exact types, calendar and vCard, extensions, then text/*."""
    ct, ext = F.lower(F.coalesce(content_type, F.lit(""))), extension(name)
    out = F.when(ct == MIME_BY_EXTENSION[".pdf"], "pdf")
    for kind in ("docx", "xlsx", "pptx"):
        out = out.when(ct == MIME_BY_EXTENSION["." + kind], kind)
    out = out.when(ct.isin(*CALENDAR_TYPES) | ext.isin(*CALENDAR_EXTENSIONS), "calendar").when(ct.isin(*VCARD_TYPES) | ext.isin(*VCARD_EXTENSIONS), "vcard")
    for kind in ("pdf", "docx", "xlsx", "pptx"):
        out = out.when(ext == "." + kind, kind)
    return out.when(ct.startswith("text/") | ext.isin(*TEXT_EXTENSIONS), "text").otherwise("unsupported")


def is_pdf(content_type: Column, name: Column) -> Column:
    return (F.lower(content_type) == "application/pdf") | F.lower(name).endswith(".pdf")


def is_readable_image(content_type: Column, name: Column) -> Column:
    """An image type but GIF, or a generic or missing type with an image extension. Null where SQL's logic says null."""
    ct = F.lower(content_type)
    return (ct.startswith("image/") & (ct != "image/gif")) | ((content_type.isNull() | ct.isin("application/octet-stream", "")) & ends_with_any(name, READABLE_IMAGES))


def reextract(kind: str | None, content_type: Column, name: Column, status: Column) -> Column:
    """Attachments to extract again for a kind of document, or those never attempted."""
    ct = F.lower(content_type)
    if kind == "calendar":
        return ct.isin(*CALENDAR_TYPES) | ends_with_any(name, CALENDAR_EXTENSIONS)
    if kind == "vcard":
        return ct.isin(*VCARD_TYPES) | ends_with_any(name, VCARD_EXTENSIONS)
    if kind == "office":
        return ct.isin(MIME_BY_EXTENSION[".xlsx"], MIME_BY_EXTENSION[".pptx"]) | ends_with_any(name, (".xlsx", ".pptx"))
    if kind == "text":
        return ct.startswith("text/") | ends_with_any(name, TEXT_EXTENSIONS)
    return status.isNull()
