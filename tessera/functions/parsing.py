"""Functions that need Python: HTML, mail, replies, chunks, calendars, cards, office files, stemming and snippets.

Each has a plain function and, at the end, a vectorised column function that takes and gives Arrow batches.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import unicodedata
import zipfile
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

_BOILERPLATE = re.compile(T.BOILERPLATE)

# --- HTML ---
# The elements that are left out or begin a line, and the depth and characters up to which a page is read.
DROPPED = frozenset("script style head meta link title noscript template address footer".split())
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header nav aside blockquote pre hr figure figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
MAX_DEPTH, MAX_HTML = 256, 1 << 20
_ZERO_OPACITY = re.compile(r"opacity\s*:\s*0(\s*(px|pt|em|%|vh|vw)?\s*)?(;|$|\s)")


def _hidden(attrs: dict[str, str]) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    style = attrs.get("style", "").lower()
    return any(f"{k}:{gap}{v}" in style for k, v in (("display", "none"), ("visibility", "hidden"), ("mso-hide", "all")) for gap in ("", " ")) or bool(_ZERO_OPACITY.search(style))


def _pixel(attrs: dict[str, str]) -> bool:
    tiny = lambda v: v.strip().rstrip("pxPX").strip() in ("0", "1")
    style = attrs.get("style", "").lower()
    return (tiny(attrs.get("width", "")) and tiny(attrs.get("height", ""))) or (re.search(r"width: ?1px", style) is not None and re.search(r"height: ?1px", style) is not None)


class _Walker(HTMLParser):
    """A stack of open elements; each holds its text until it closes, when it is kept or dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[str]]] = [("", False, [])]

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        while self.open[-1][0] in CLOSED_BY and tag in CLOSED_BY[self.open[-1][0]]:
            self._close()
        if tag == "br":
            self.open[-1][2].append("\n")
        if tag in VOID:
            if tag == "hr" and not _hidden(own):
                self.open[-1][2].append("\n\n")
            return
        dropped = tag in DROPPED or _hidden(own) or (tag == "img" and _pixel(own)) or len(self.open) > MAX_DEPTH
        dropped = dropped or (tag == "a" and any(p in own.get("href", "").lower() for p in T.BOILERPLATE_LINKS))
        self.open.append((tag, dropped, []))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def _close(self):
        tag, dropped, parts = self.open.pop()
        inner = "".join(parts)
        if dropped or (tag == "a" and not inner.strip()):
            return
        self.open[-1][2].append(f"\n- {inner}" if tag == "li" else f"\n{inner}\n" if tag in BLOCKS else f"{inner} " if tag in ("td", "th") else inner)

    def text(self) -> str:
        while len(self.open) > 1:
            self._close()
        return "".join(self.open[0][2])


def normalize_text(s: str) -> str:
    seen = "".join(" " if c in T.NBSP else c for c in s if c != T.JOINER and unicodedata.category(c) != "Cf")
    body = "\n".join(x.strip() for x in re.sub(r"[^\S\n]+", " ", seen).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", body).strip()


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    walker = _Walker()
    walker.feed(html[:MAX_HTML])
    walker.close()
    return "\n".join(x for x in normalize_text(walker.text()).split("\n") if not _BOILERPLATE.search(x))


# --- replies ---
_ON_WROTE = re.compile(r"^\s*On .+ wrote:?\s*$")


def trim_reply(body: str | None, subject: str | None) -> str:
    """What stands above the quoted message, without quoted lines; forwards are kept whole."""
    if not body:
        return body or ""
    lines, reply = body.split("\n"), (subject or "").lower().startswith("re:")

    def header_block(i: int) -> bool:
        near = [x.lstrip() for x in lines[i + 1 : i + 7]]
        return lines[i].lstrip().startswith("From: ") and sum(x.startswith(("Sent: ", "To: ", "Subject: ")) for x in near) >= 2

    cut = next((i for i, x in enumerate(lines) if _ON_WROTE.match(x) or x.strip().lower() == "-----original message-----" or (reply and header_block(i))), len(lines))
    return "\n".join(x for x in lines[:cut] if not x.lstrip().startswith(">")).strip()


def collapse_repeats(s: str | None) -> str:
    """Of equal lines that follow each other, other than blank ones, the first."""
    lines = (s or "").split("\n")
    return "\n".join(x for i, x in enumerate(lines) if not i or not x.strip() or x != lines[i - 1])


# --- chunks ---
CHARS_PER_TOKEN = 4


def chunk_text(body: str | None, size_tokens: int = 200, overlap_tokens: int = 32) -> list[str]:
    """Paragraphs packed into chunks that overlap; longer paragraphs cut by a sliding window."""
    if overlap_tokens > max(1, size_tokens) // 2:
        raise ValueError("the overlap is more than half the chunk size")
    most, lap = max(1, size_tokens) * CHARS_PER_TOKEN, max(0, overlap_tokens) * CHARS_PER_TOKEN
    text = (body or "").strip()
    if len(text) <= most:
        return [text] if text else []
    out, held, fresh = [], "", False
    for para in filter(None, (p.strip() for p in re.split(r"\r\n\r\n|\n\n", text))):
        if fresh and len(held) + 2 + len(para) > most:
            out.append(held)
            held, fresh = held[-lap:] if lap and len(held) > lap else "", False
        if len(para) > most:
            if fresh:
                out.append(held)
            held, fresh = "", False
            last = max(0, -(-(len(para) - most) // (most - lap)))
            out += [para[i * (most - lap) :][:most] for i in range(last + 1)]
            continue
        held, fresh = f"{held}\n\n{para}" if held else para, True
    return [*out, held] if fresh else out


# --- calendars and cards ---
def _unfold(text: str) -> list[str]:
    return [x for x in re.sub(r"\n[ \t]", "", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n") if x]


def _property(line: str) -> tuple[str, str, str]:
    head, _, value = line.partition(":")
    name, _, params = head.partition(";")
    return name.strip().upper(), params, value


def _unescape(v: str) -> str:
    return re.sub(r"\\([nN,;\\])", lambda m: "\n" if m[1] in "nN" else m[1], v)


def _common_name(params: str, value: str) -> str:
    m = re.search(r'(?:^|;)CN=(?:"([^"]*)"|([^;]*))', params, re.I)
    return (m[1] or m[2]) if m else re.sub(r"(?i)^mailto:", "", value)


def _joined(value: str, gap: str) -> str:
    return gap.join(filter(None, (_unescape(p).strip() for p in re.split(r"(?<!\\);", value))))


def extract_calendar(text: str) -> str:
    labels = {"SUMMARY": "", "DESCRIPTION": "", "COMMENT": "", "LOCATION": "Location", "DTSTART": "When", "ORGANIZER": "Organizer", "ATTENDEE": "Attendee"}
    out = []
    for name, params, value in map(_property, _unfold(text)):
        if name in labels:
            shown = _common_name(params, value) if name in ("ORGANIZER", "ATTENDEE") else value if name == "DTSTART" else _unescape(value)
            if shown.strip():
                out.append(f"{labels[name]}: {shown.strip()}" if labels[name] else shown.strip())
    return "\n".join(out)


def extract_card(text: str) -> str:
    import quopri

    out, full, name_parts = [], False, ""
    joined = re.sub(r"=\n", "", text.replace("\r\n", "\n")) if "QUOTED-PRINTABLE" in text.upper() else text
    for name, params, value in map(_property, _unfold(joined)):
        if "QUOTED-PRINTABLE" in params.upper():
            value = quopri.decodestring(value.encode()).decode("utf-8", "replace")
        shown = {"FN": ("", _unescape), "NICKNAME": ("Nickname", _unescape), "ORG": ("Org", lambda v: _joined(v, " ")), "TITLE": ("Title", _unescape), "EMAIL": ("Email", str), "TEL": ("Tel", str), "ADR": ("Address", lambda v: _joined(v, ", ")), "URL": ("URL", str), "NOTE": ("", _unescape)}.get(name)
        if name == "N":
            name_parts = _joined(value, " ")
        if shown and (v := shown[1](value).strip()):
            out.append(f"{shown[0]}: {v}" if shown[0] else v)
            full |= name == "FN"
    return "\n".join(out if full or not name_parts else [*out, name_parts])


# --- office files ---
MAX_PART = 64 << 20


def _xml(z: zipfile.ZipFile, name: str):
    if z.getinfo(name).file_size > MAX_PART:
        raise ValueError("a part is too large")
    return ElementTree.fromstring(z.read(name))


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def extract_office(data: bytes, kind: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        numbered = lambda prefix: sorted((n for n in names if re.fullmatch(prefix + r"\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        texts = lambda node: "".join(t.text or "" for t in node.iter() if _local(t) == "t")
        if kind == "docx":
            return "\n".join(texts(p) for p in _xml(z, "word/document.xml").iter() if _local(p) == "p")
        if kind == "pptx":
            return "\n\n".join("\n".join(filter(None, (texts(p) for p in _xml(z, n).iter() if _local(p) == "p"))) for n in numbered("ppt/slides/slide"))
        shared = [texts(s) for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in names else []
        sheets = [s.get("name") for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"] if "xl/workbook.xml" in names else []
        out = list(sheets)
        for n in numbered("xl/worksheets/sheet"):
            for c in (c for c in _xml(z, n).iter() if _local(c) == "c"):
                v = next((x.text for x in c if _local(x) == "v"), None)
                cell = shared[int(v)] if c.get("t") == "s" and v is not None else texts(c) if c.get("t") == "inlineStr" else v
                out.append(cell or "")
        return "\n".join(filter(None, out))


MAX_ATTACHMENT, MAX_TEXT = 25 << 20, 2_000_000
# Charsets that are declared where the text is often UTF-8.
LATIN = ("", "iso-8859-1", "latin-1", "us-ascii", "ascii", "windows-1252", "utf-8")


def decode_text(data: bytes | None, charset: str | None) -> str | None:
    """A declared charset other than Latin strictly, then UTF-8 strictly, then as declared, then Windows-1252."""
    if data is None:
        return None
    latin = (charset or "").lower().replace("_", "-") in LATIN
    for c in ([] if latin else [charset]) + ["utf-8"] + ([charset] if charset else []):
        try:
            return data.decode(c)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("cp1252", "replace")


def extract(data: bytes | None, kind: str, charset: str | None = None) -> tuple[str | None, str]:
    """(text, status): done, no_text, failed, oversize or unsupported."""
    if data is None:
        return None, "failed"
    if len(data) > MAX_ATTACHMENT:
        return None, "oversize"
    try:
        if kind in ("docx", "xlsx", "pptx"):
            raw = extract_office(data, kind)
        elif kind in ("text", "calendar", "vcard"):
            raw = {"text": str, "calendar": extract_calendar, "vcard": extract_card}[kind](decode_text(data, charset))
        else:
            return None, "unsupported"
    except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError):
        return None, "failed"
    plain = re.sub("[\0\ufeff]", "", raw).replace("\r", "\n")
    out = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in plain.split("\n"))).strip()[:MAX_TEXT]
    return (out, "done") if out else (None, "no_text")


# --- mail ---
_HEADERS = email.policy.default.header_factory


@lru_cache(1 << 10)
def _content_header(name: str, value: str):
    return _HEADERS(name, value)


def _header(name: str, value: str):
    """A parsed header; those of parts repeat from message to message and are parsed once."""
    return _content_header(name, value) if name.lower().startswith("content-") and len(value) <= 200 else _HEADERS(name, value)


_MAIL = email.policy.default.clone(header_factory=_header)


def _parts(m: email.message.EmailMessage) -> list[tuple[str | None, str, bytes]]:
    """(name, type, bytes) of what a message carries: attachments first, then images that stand inline."""
    attached, inline = [], []
    for p in m.walk():
        if p.is_multipart():
            continue
        where = attached if p.get_content_disposition() == "attachment" else inline if p.get_content_maintype() == "image" else None
        if where is not None:
            where.append((p.get_filename(), p.get_content_type(), p.get_payload(decode=True) or b""))
    return attached + inline


def indexable_parts(raw: bytes) -> list[tuple[str | None, str, bytes]]:
    return _parts(email.message_from_bytes(raw, policy=_MAIL))


def parse_message(raw: bytes) -> dict:
    """One MIME message: headers, thread, bodies and parts."""
    m = email.message_from_bytes(raw, policy=_MAIL)
    bare = lambda v: (v or "").strip().strip("<>") or None
    people = lambda h: [{"name": a.display_name or None, "address": a.addr_spec} for a in (m[h].addresses if m[h] else ())]
    text, html = m.get_body(("plain",)), m.get_body(("html",))
    body_html = html.get_content() if html else None
    plain = text.get_content() if text else None
    body = html_to_text(body_html) if body_html else plain or ""
    _, _, payload = raw.replace(b"\r\n", b"\n").partition(b"\n\n")
    body_hash = hashlib.sha256(payload).hexdigest()
    sender = (people("from") or [{"name": None, "address": None}])[0]
    when = m["date"].datetime.isoformat() if m["date"] and m["date"].datetime else None
    own = bare(m["message-id"]) or hashlib.sha256("\n".join((when or "", sender["address"] or "", m["subject"] or "", body_hash)).encode()).hexdigest() + "@synthetic.local"
    refs = re.findall(r"<([^>]+)>", str(m["references"] or ""))
    return {
        "message_id": own, "thread_id": (refs or [None])[0] or bare(m["in-reply-to"]) or own, "subject": m["subject"], "from_address": sender["address"],
        "from_name": sender["name"], "to_addresses": people("to"), "cc_addresses": people("cc"), "date_sent_raw": when,
        "body_text": trim_reply(normalize_text(body), m["subject"]), "body_html": body_html, "size_bytes": len(raw), "content_hash": body_hash,
        "attachments": [{"part_index": i, "filename": n, "content_type": k, "size_bytes": len(d)} for i, (n, k, d) in enumerate(_parts(m))],
    }


# --- stemming: the algorithm published by M. F. Porter in 1980 ---
def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub("c+", "c", re.sub("v+", "v", _shape(stem)))))


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(1 << 17)
def stem(w: str, letters: bool = True) -> str:
    """The stem; with letters only of words of a to z."""
    if len(w) < 3 or (letters and not (w.isascii() and w.isalpha())):
        return w
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and "v" in _shape(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        a = max((s for s in table if w.endswith(s)), key=len, default=None)
        if a is not None and _measure(w[: -len(a)]) > 0:
            w = w[: -len(a)] + table[a]
    a = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if a and _measure(w[: -len(a)]) > 1 and (a != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(a)]
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def fold(w: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")


def stemmed_tokens(text: str | None) -> list[str]:
    return [stem(fold(t)) for t in re.findall(r"[^\W_]+", (text or "").lower())]


@lru_cache(1 << 12)
def _plain_letter(c: str) -> str:
    n = unicodedata.normalize("NFD", c)
    return n[0] if len(n) == 2 and n[0].isascii() and unicodedata.category(n[1]) == "Mn" else c


def fold_latin(text: str) -> str:
    """Lower case, Latin letters without their diacritic and marks U+0300 to U+0331 gone, as SQLite's unicode61 does it."""
    if text.isascii():
        return text.lower()
    return "".join(_plain_letter(c) for c in text if not "\u0300" <= c <= "\u0331").lower()


@lru_cache(1 << 17)
def porter_term(token: str) -> str:
    """The stem of a folded token; the suffix rules ask nothing of the other characters, and over 64 bytes none applies."""
    return stem(token, False) if len(token.encode("utf-8", "surrogatepass")) <= 64 else token


def porter_tokens(text: str | None) -> list[str]:
    """The terms of SQLite's tokenizer 'porter unicode61'."""
    return [porter_term(t) for t in re.findall(r"[^\W_]+", fold_latin(text or ""))]


def make_snippet(text: str | None, terms: list[str], width: int = 12, term_of: Callable[[str], str] = str.lower) -> str:
    """The run of `width` tokens with most distinct terms, hits in brackets, an ellipsis where it is cut."""
    spans = [(m.start(), m.end(), term_of(m[0])) for m in re.finditer(r"[^\W_]+", text or "")]
    if not spans:
        return ""
    want = set(terms)
    best = max(range(max(1, len(spans) - width + 1)), key=lambda i: (len({t for _, _, t in spans[i : i + width]} & want), -i))
    out, at, window = "", spans[best][0], spans[best : best + width]
    for a, b, t in window:
        out += text[at:a] + (f"[{text[a:b]}]" if t in want else text[a:b])
        at = b
    return ("\u2026 " if best else "") + out + (" \u2026" if best + width < len(spans) else "")


#: Scores of a window: a phrase it holds, one more place of that, and a window that begins with a sentence, or with the text.
NEW_PHRASE, SAME_PHRASE, AT_SENTENCE, AT_START = 1000, 1, 100, 120


def _tokens(text: str, term_of: Callable[[str], str]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), term_of(m[0])) for m in re.finditer(r"[^\W_]+", text)]


def _phrase_places(terms: list[str], phrases: list[tuple[tuple[str, ...], bool, bool]]) -> list[tuple[int, int]]:
    """(place, number of the phrase) in order; a phrase is its terms, whether its last is a prefix, whether it must come first."""
    out = []
    for number, (wanted, prefix, anchored) in enumerate(phrases):
        last = len(wanted) - 1
        for at in range(1 if anchored and terms else len(terms) - last) if last >= 0 else ():
            if at + last < len(terms) and all(terms[at + k].startswith(w) if prefix and k == last else terms[at + k] == w for k, w in enumerate(wanted)):
                out.append((at, number))
    return sorted(out)


def _sentence_starts(text: str, tokens: list[tuple[int, int, str]]) -> list[int]:
    """The tokens that begin the text, or follow a full stop or colon with nothing but blanks between."""
    return [k for k, (begin, _, _) in enumerate(tokens) if not k or text[:begin].rstrip(" \t\r\n")[-1:] in (".", ":")]


def best_snippet(cells: list[str | None], phrases: list[tuple[tuple[str, ...], bool, bool, tuple[int, ...]]], width: int = 12, term_of: Callable[[str], str] = str.lower, ellipsis: str = " \u2026 ") -> str:
    """The window of `width` tokens, of all cells, that holds most different phrases; then most places, then a sentence's start.

    phrases are (terms, prefix, anchored, numbers of the cells they count in). A window is centred on what it holds, or begins
    with the sentence of a place; the first of equals is taken. Places are in brackets, overlapping ones in one pair.
    """
    best, shown = 0, (0, 0, [], [])
    for number, cell in enumerate(cells):
        tokens = _tokens(cell or "", term_of)
        here = [(t, p, a) if number in where else ((), p, a) for t, p, a, where in phrases]
        places = _phrase_places([t for _, _, t in tokens], here)
        starts = _sentence_starts(cell or "", tokens) if places else []
        held = [p for p, _ in places]

        def worth(begin: int, places=places, held=held) -> tuple[int, list[tuple[int, int]]]:
            inside = places[bisect_left(held, begin) : bisect_left(held, begin + width)]
            kinds = len({n for _, n in inside})
            return NEW_PHRASE * kinds + SAME_PHRASE * (len(inside) - kinds), inside

        for at in held:
            score, inside = worth(at)
            if score > best:
                first, last = inside[0][0], inside[-1][0] + len(here[inside[-1][1]][0])
                slack = width - (last - first)
                centred = first - (slack // 2 if slack >= 0 else -(-slack // 2))
                best, shown = score, (number, max(0, min(centred, len(tokens) - width)), tokens, places)
            sentence = starts[max(0, bisect_right(starts, at) - 1)]
            if len(tokens) > width and sentence < at:
                score = worth(sentence)[0] + (AT_SENTENCE if sentence else AT_START)
                if score > best:
                    best, shown = score, (number, sentence, tokens, places)
    number, begin, tokens, places = shown
    return _bracketed(cells[number] or "", begin, width, tokens or _tokens(cells[number] or "", term_of), places, phrases, ellipsis)


def _bracketed(cell: str, begin: int, width: int, tokens, places, phrases, ellipsis: str) -> str:
    end = min(begin + width, len(tokens))
    spans: list[list[int]] = []
    for at, n in places:
        stop = at + len(phrases[n][0])
        if spans and at < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([at, stop])
    out, at = (ellipsis if begin else ""), (tokens[begin][0] if begin else 0)
    for a, b in spans:
        a, b = max(a, begin), min(b, end)
        if a < b:
            out += cell[at : tokens[a][0]] + "[" + cell[tokens[a][0] : tokens[b - 1][1]] + "]"
            at = tokens[b - 1][1]
    if end >= len(tokens):
        return out + cell[at:]
    return out + cell[at : tokens[end - 1][1]] + ellipsis


# --- transcription scores ---
class _Kept(dict):
    """Code point -> itself if it is kept, else a blank."""

    def __init__(self, kept: Callable[[str], bool]):
        super().__init__()
        self.kept = kept

    def __missing__(self, point: int) -> str:
        self[point] = out = chr(point) if self.kept(chr(point)) else " "
        return out


#: What pages are compared on, letters, decimal digits and blanks; and what tokens are made of.
_COMPARED = _Kept(lambda c: unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c.isspace())
_WORDS = _Kept(str.isalnum)


def ocr_normalize(s: str | None) -> str:
    """Words of letters and digits in lower case, without image links and targets of links; markup and rules of lines are blanks too."""
    plain = s or ""
    if "[" in plain:
        plain = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", plain))
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", plain)
    return " ".join(plain.translate(_COMPARED).split()).lower()


def word_tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return (text or "").lower().translate(_WORDS).split()


def word_search(text: str | None) -> bool:
    """Whether there is any token."""
    return re.search(r"[^\W_]", (text or "").lower()) is not None


def multiset_f1(a: Counter, b: Counter) -> float:
    """2 |a and b| / (|a| + |b|), each token as often as it stands; one of them is not empty."""
    return 2.0 * sum(min(n, b[t]) for t, n in a.items()) / (a.total() + b.total())


@lru_cache(8)
def _counted(text: str | None) -> Counter:
    """Of the last few texts: results of one page by several engines share their reference."""
    return Counter(word_tokens(text))


def token_f1(reference: str | None, hypothesis: str | None) -> float | None:
    a, b = _counted(reference), Counter(word_tokens(hypothesis))
    return multiset_f1(a, b) if a or b else None


def _long_distance(a: np.ndarray, b: np.ndarray) -> int:
    """edit_distances() of one pair, a column of the table in one integer of any length."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    whole, last, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = whole, 0
    for y in b.tolist():
        eq = at.get(y, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (whole & ~(xh | up)), up & xh
        score += (ph >> last & 1) - (mh >> last & 1)
        ph, mh = (ph << 1 | 1) & whole, mh << 1 & whole
        up, down = mh | (whole & ~(xv | ph)), ph & xv
    return score


def _distances(pairs: list[tuple[np.ndarray, np.ndarray]], words: int) -> np.ndarray:
    """edit_distances() of pairs whose first fills at most `words` words of 64 bits and is not empty, side by side."""
    n, one = len(pairs), np.uint64(1)
    m, ends = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    first, second = np.zeros((m.max(), n), np.int64), np.zeros((ends.max(), n), np.int64)
    for k, (a, b) in enumerate(pairs):
        first[: len(a), k], second[: len(b), k] = a, b
    side, symbols = np.arange(n), int(max(first.max(), second.max(initial=0))) + 1
    at = np.zeros((words, symbols * n), np.uint64)
    for i, codes in enumerate(first):
        some = m > i
        at[i // 64, (codes * n + side)[some]] |= one << np.uint64(i % 64)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score, block, bit = m.copy(), (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    blocks = [np.flatnonzero(block == w) for w in range(words)]
    for j, codes in enumerate(second):
        where, alive = codes * n + side, ends > j
        ph_in, mh_in = one, np.uint64(0)
        for w in range(words):
            eq, p, d = at[w].take(where), up[w], down[w]
            xv, eq = eq | d, eq | mh_in
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = d | ~(xh | p), p & xh
            if len(mine := blocks[w]):
                moved = (ph[mine] >> bit[mine] & one).astype(np.int64) - (mh[mine] >> bit[mine] & one).astype(np.int64)
                score[mine] += np.where(alive[mine], moved, 0)
            ph_out, mh_out = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = ph << one | ph_in, mh << one | mh_in
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            ph_in, mh_in = ph_out, mh_out
    return score


#: Pairs that are worked on side by side, the bytes that their tables may take, and the words from which pairs go one by one.
SIDE_BY_SIDE, TABLE_BYTES, LONG_WORDS = 4096, 32 << 20, 16


def _bounds(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the edit distance of each pair can be: by what one holds more of than the other, and place by place."""
    n, symbols = len(pairs), max(int(x.max(initial=0)) for p in pairs for x in p) + 1
    size, flat, owner = [], [], []
    for k in (0, 1):
        size.append(np.array([len(p[k]) for p in pairs]))
        flat.append(np.concatenate([p[k] for p in pairs]))
        owner.append(np.repeat(np.arange(n), size[k]))
    more = np.subtract(*(np.bincount(o * symbols + f, minlength=n * symbols) for o, f in zip(owner, flat, strict=True))).reshape(n, symbols)
    least = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    alike = size[0] == size[1]
    a, b = (f[alike[o]] for f, o in zip(flat, owner, strict=True))
    most = np.where(alike, 0, size[0] + size[1])
    most[alike] = np.bincount(owner[0][alike[owner[0]]], a != b, minlength=n)[alike]
    return least, most


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The edit distance of each pair of arrays of codes, small numbers from 0.

    Where the bounds of a pair meet, as they do if symbols were only exchanged for others, that is it. The rest by bits (Myers,
    Hyyro): 64 cells of the table at a time, and many pairs at once.
    """
    out, some = np.array([len(a) or len(b) for a, b in pairs], np.int64), []  # right where one of them is empty
    filled = [k for k, (a, b) in enumerate(pairs) if len(a) and len(b)]
    for group in _grouped(filled, pairs):
        least, most = _bounds([pairs[k] for k in group])
        out[group] = least
        some += [group[k] for k in np.flatnonzero(least < most)]
    width = {k: -(-len(pairs[k][0]) // 64) for k in some}
    for k in (k for k in some if width[k] > LONG_WORDS):
        out[k] = _long_distance(*pairs[k])
    for words in sorted({w for w in width.values() if w <= LONG_WORDS}):
        mine = sorted((k for k in some if width[k] == words), key=lambda k: len(pairs[k][1]))
        for group in _grouped(mine, pairs, words):
            out[group] = _distances([pairs[k] for k in group], words)
    return out


def _grouped(some: list[int], pairs: list[tuple[np.ndarray, np.ndarray]], words: int = 1) -> Iterator[list[int]]:
    """Runs of pairs with at most TABLE_BYTES of tables, or single ones."""
    group, symbols = [], 1
    for k in some:
        wider = max(symbols, *(int(x.max()) + 1 for x in pairs[k]))
        if group and (len(group) == SIDE_BY_SIDE or (len(group) + 1) * wider * words * 8 > TABLE_BYTES):
            yield group
            group, wider = [], max(int(x.max()) + 1 for x in pairs[k])
        group.append(k)
        symbols = wider
    if group:
        yield group


def edit_distance(a: list, b: list) -> int:
    codes: dict = {}
    both = [np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (a, b)]
    return int(edit_distances([tuple(both)])[0])


@lru_cache(8)
def _compared_words(text: str | None) -> tuple[str, ...]:
    return tuple(ocr_normalize(text).split())


def word_error_rates(references: list[str | None], hypotheses: list[str | None]) -> list[float]:
    """Of each pair the edit distance over words, by the reference's words, at most 1."""
    pairs = []
    for reference, hypothesis in zip(references, hypotheses, strict=True):
        a, b, codes = _compared_words(reference), ocr_normalize(hypothesis).split(), {}
        first = np.array([codes.setdefault(x, len(codes) + 1) for x in a], np.int64)
        pairs.append((first, np.array([codes.get(x, 0) for x in b], np.int64)))
    return [min(1.0, int(d) / len(a)) if len(a) else float(len(b) > 0) for (a, b), d in zip(pairs, edit_distances(pairs), strict=True)]


def word_error_rate(reference: str | None, hypothesis: str | None) -> float:
    return word_error_rates([reference], [hypothesis])[0]


def character_errors(references: list[str | None], hypotheses: list[str | None]) -> list[float | None]:
    """Of each pair the edit distance over the reference's length, at most 1; 1 if one is null, null if the reference is empty then."""
    sides = [[x or "" for x in references], [x or "" for x in hypotheses]]
    points = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in sides]
    seen = np.zeros(0x110000, bool)
    for x in points:
        seen[x] = True
    codes = np.cumsum(seen) - 1
    raw = list(zip(*(np.split(codes[x], np.cumsum([len(t) for t in side])[:-1]) for x, side in zip(points, sides, strict=True)), strict=True))
    distances = edit_distances(raw)
    out: list[float | None] = []
    for r, h, (a, b), d in zip(references, hypotheses, raw, distances, strict=True):
        if r is None or h is None:
            out.append(None if r == "" else 1.0)
        else:
            out.append(min(1.0, int(d) / len(a)) if len(a) else float(len(b) > 0))
    return out


#: Rows of which a column function holds values at a time.
ROWS = 256


def column_of(function: Callable, returns: str, *columns, rows: int = SIDE_BY_SIDE, shared: bool = False):
    """function over lists of the columns' values, of `rows` rows at most; what they give is Arrow again, and leaves before the next are read.

    So of a batch no more than its input is held. shared gives a batch's results at once instead, for several such columns
    of one select: those take one Python process a task, others one each.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(returns))

    def parts(arrays: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        return (pa.array(function(*(x.slice(k, rows).to_pylist() for x in arrays)), kind) for k in range(0, len(arrays[0]), rows))

    def at_once(*arrays: pa.Array) -> pa.Array:
        return pa.concat_arrays(parts(arrays)) if len(arrays[0]) else pa.array([], kind)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield from parts((array,))

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            yield from parts(arrays)

    return F.arrow_udf(at_once if shared else one if len(columns) == 1 else several, returns)(*columns)


def column(function: Callable, returns: str, *columns, shared: bool = False):
    """function over columns, some rows at a time."""
    return column_of(lambda *lists: [function(*row) for row in zip(*lists, strict=True)], returns, *columns, rows=ROWS, shared=shared)


def decoded(data: Column, charset: Column) -> Column:
    """decode_text; what is UTF-8 under no name or a Latin one is so in Spark, and only other bytes go to Python."""
    latin = F.replace(F.lower(F.coalesce(charset, F.lit(""))), F.lit("_"), F.lit("-")).isin(*LATIN)
    plain = F.when(latin, F.try_validate_utf8(data.cast("string")))
    return F.coalesce(plain, column(decode_text, "string", F.when(plain.isNull(), data), charset))
