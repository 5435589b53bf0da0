"""Text functions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces that do not break, and the invisible joiner that is no format character.
NBSP, JOINER = "\u00a0\u2007\u202f", "\u034f"
# Lines of mail boilerplate.
BOILERPLATE_LINES = (
    r"(?i:^\s*(©|\(c\)|copyright)\s*\d{4})",
    r"(?i:^\s*(®|™|tm)\s*(and\s*)?(©|\(c\))\s*\d{4})",
    r"(?i:^\s*all rights reserved\b)",
    r"(?i:^\s*(view|read|see) (this )?(email |message |newsletter )?(in (your |a )?browser|on the web|web version|online)\b)",
    r"(?i:^\s*having (trouble|difficulty) (reading|viewing) this)",
    r"(?i:^\s*if (you('re| are) )?having (trouble|difficulty))",
    r"(?i:^\s*unsubscribe\b)",
    r"(?i:^\s*(update|manage|change) (your )?(email )?(preferences|subscription|settings))",
    r"(?i:^\s*you('re| are) receiving this (email|message|newsletter))",
    r"(?i:^\s*this (email|message) (was|is being) sent (to|from|by))",
    r"(?i:^\s*(don'?t|do not) (want|wish) to receive)",
    r"(?i:^\s*to (stop|opt out of|unsubscribe from) (receiving|these))",
    r"(?i:^\s*(email|message|reference|tracking)\s+(reference\s+)?id\s*:)",
    r"(?i:^\s*(forward|share) this (email|message|newsletter))",
    r"(?i:^\s*(privacy policy|terms of (service|use)|cookie policy)\s*[|·•\-]?\s*$)",
    r"^\s*[A-Za-z][\w &]{0,29}(\s*[•·|]\s*[A-Za-z][\w &]{0,29}){1,4}\s*$",
    r"^\s*[\w][\w &./-]{1,58}\s*[›>]\s*$",
    r"(?i:^\s*if you have any questions about your (bill|order|subscription|payment|account)\b)",
    r"(?i:^\s*you may contact .{1,40} for a (full |partial )?refund)",
    r"(?i:^\s*partial refunds are available)",
    r"(?i:^\s*you can turn off (renewal|automatic|email)\s+(receipts?|payments?|emails?))",
    r"(?i:^\s*turn off (renewal|automatic|email)\s+(receipts?|payments?|emails?))",
    r"(?i:^\s*get help with (subscriptions|orders|purchases|your account|billing)\b)",
    r"(?i:^\s*view your receipts? anytime\b)",
    r"@@\w+@@|\{\{\w+\}\}",
)
# Parts of link targets that mark subscription chores.
BOILERPLATE_LINKS = (
    "unsubscribe", "/optout", "/opt-out", "/opt_out", "manage_preferences", "manage-preferences", "email_preferences", "email-preferences",
    "emailpreferences", "pref_center", "preference-center", "preference_center", "manage-subscriptions", "manage_subscriptions",
    "update-preferences", "update_preferences", "list-unsubscribe",
)
#: One expression for all lines, so a line is looked at once.
BOILERPLATE = "|".join(f"(?:{p})" for p in BOILERPLATE_LINES)
PLACEHOLDER = r"!\[[^\]]*\]\([^)]*\)"


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def normalize(c: Column) -> Column:
    """Invisible characters go, whitespace within lines becomes one space, lines are trimmed, at most one is blank."""
    seen = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cf}" + JOINER + "]", "")
    spaced = F.regexp_replace(F.translate(seen, NBSP, "   "), r"[^\S\n]+", " ")
    trimmed = F.regexp_replace(F.regexp_replace(spaced, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.btrim(trimmed, F.lit(" \n\t\r"))


def strip_boilerplate(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~x.rlike(BOILERPLATE)), "\n")


def is_boilerplate_link(href: Column) -> Column:
    return F.lower(href).rlike("|".join(BOILERPLATE_LINKS))


def truncate(c: Column, n: int) -> Column:
    """At most n code points, then an ellipsis."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("\u2026"))).otherwise(c)


def snippet(c: Column, n: int) -> Column:
    return truncate(F.trim(F.regexp_replace(c, r"\s+", " ")), n)


def strip_placeholders(c: Column, cap: int = 0) -> Column:
    """Image placeholders go, and the blank lines they leave."""
    kept = F.filter(F.transform(lines(F.regexp_replace(c, PLACEHOLDER, "")), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    out = F.trim(F.array_join(kept, "\n"))
    return F.substring(out, 1, cap) if cap else out


def normalize_extracted(c: Column, cap: int = 2_000_000) -> Column:
    """NUL and byte order marks go, CR is LF, line ends are trimmed, at most one line is blank."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\x{0}\x{FEFF}]", ""), r"\r", "\n")
    joined = F.regexp_replace(F.regexp_replace(plain, r"[^\S\n]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(joined, r"^\s+|\s+$", ""), 1, cap)


def markdown_link(label: Column, url: Column) -> Column:
    safe = F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.concat(F.lit("["), F.regexp_replace(safe, r"[\r\n]", " "), F.lit("]("), url, F.lit(")"))


def webmail_link(base: Column, account: str, message_id: Column) -> Column:
    escaped = F.regexp_replace(F.url_encode(message_id), r"\+", "%20")
    return F.when(base != "", F.concat(base, F.lit(f"/mail/{account}/search:msgid%3A"), escaped))


def embedding_text(subject: Column, names: Column, body: Column) -> Column:
    """Subject, attachment names and body, blank lines between; empty ones are left out."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n\n", some(subject), F.when(F.trim(names) != "", F.concat(F.lit("Attachments: "), names)), some(body))


def thread_id(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    bare = lambda c: F.btrim(c, F.lit("<> "))
    return F.coalesce(F.nullif(bare(F.try_element_at(references, F.lit(1))), F.lit("")), F.nullif(bare(in_reply_to), F.lit("")), bare(message_id))


def synthetic_message_id(date: Column, sender: Column, subject: Column, body_hash: Column, suffix: str = "@synthetic.local") -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (date, sender, subject, body_hash)]
    return F.concat(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(suffix))


def hard_split(c: Column, size: int, step: int) -> Column:
    """Overlapping slices of a long block."""
    n = F.char_length(c)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))


def ocr_fold(c: Column) -> Column:
    """The letters and digits that transcriptions are compared on, without the compatibility fold."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PLACEHOLDER, " "), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[#*_`~>|]+", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{Nd}\s]+", " "), r"\s+", " ")))


def error_kind(line: Column) -> Column:
    """What a line of a mail-sync log says went wrong; the first that fits."""
    has = lambda *words: F.lower(line).rlike("|".join(words))
    return (
        F.when(has("is locked"), "locked").when(has("cannot resolve", "nodename nor servname"), "dns")
        .when(line.startswith("Socket error") | has("timeout", "connection reset"), "network")
        .when(has("authentication", "login failed", "authenticate failed"), "auth").otherwise("other")
    )


def http_failure(status: Column, body: Column) -> Column:
    too_long = F.lower(body).rlike("context|maximum length|too long|max_tokens")
    return (
        F.when((status == 400) & too_long, "input_too_long").when(status.isin(400, 401, 403), "auth_or_config")
        .when(status == 404, "model_unavailable").when(status.isin(429, 503), "backpressure").otherwise("transient")
    )


def config_hash(space: Column, model: Column, dims: Column, *affixes: Column) -> Column:
    """SHA-256 over the fields of an embedding configuration, each with its name and length."""
    names = ("spaceId", "wireModel", "dimensions", "queryPrefix", "querySuffix", "documentPrefix", "documentSuffix", "normalization")
    values = [space, model, dims.cast("string"), *affixes]
    return F.sha2(F.concat(F.lit("v2\n"), *(F.concat(F.lit(n + ":"), F.char_length(v).cast("string"), F.lit(":"), v, F.lit("\n")) for n, v in zip(names, values, strict=True))), 256)
