"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds are proposed by regular expressions over the whole text, leftmost first and without overlap within a kind. A proposal
that its validator refuses (Luhn for cards, mod-97 for bank accounts, ranges and numbers of digits for the rest) is
dropped. What stays scores its kind's prior, plus a bonus where a checksum has confirmed it, plus or minus a share for each of
the kind's telling and misleading words among those within NEARBY characters. Base kinds (email, ip, card, phone) are
reported whatever they score; the others if they reach `least` and overlap no base span.

Every search is linear in the text: runs of digits and of address characters are entered at their first character only.

Defined results: a null text is empty and has no spans. A null or repeated id is a row like any other. Places are code
points, ends exclusive. An empty table gives an empty table. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.words import slices

#: Characters on either side in which words count; score from which a kind outside the base is reported.
NEARBY, LEAST = 48, 0.6
CHECKSUM, TELLING, MISLEADING = 0.3, 0.3, 0.3
WORD = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Of an account number: its first four characters to the end, letters as 10 to 35, and 1 is left over."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from its @."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _found(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers in groups; what follows one in capitals is cut off group by group until the checksum holds."""
    at = 0
    while found := ACCOUNT.search(text, at):
        begin, end = found.span()
        while end > begin and not (15 <= len(code := text[begin:end].replace(" ", "")) <= 34 and mod97(code)):
            end = max(text.rfind(" ", begin, end), begin)
        if end > begin:
            yield begin, end
        at = max(end, begin + 1) if end > begin else found.end()


@dataclass(frozen=True)
class Kind:
    """valid gives None for a refused span, else whether a checksum has confirmed it."""

    name: str
    spans: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool | None]
    prior: float
    telling: frozenset[str]
    misleading: frozenset[str] = frozenset()
    mark: str = ""  # a character without which there is nothing to find

    def score(self, text: str, begin: int, end: int, confirmed: bool) -> float:
        near = text[max(0, begin - NEARBY) : begin] + " " + text[end : end + NEARBY]
        words = {w.lower() for w in WORD.findall(near)}
        out = self.prior + CHECKSUM * confirmed + TELLING * len(words & self.telling) - MISLEADING * len(words & self.misleading)
        return round(min(1.0, max(0.0, out)), 3)


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _address(text: str) -> bool | None:
    parts = [p.lstrip("0") for p in text.split(".")]
    return False if all(len(p) < 4 and int(p or "0") <= 255 for p in parts) else None


def _card(low: int, high: int) -> Callable[[str], bool | None]:
    return lambda text: True if low <= len(d := digits_of(text)) <= high and luhn(d) else None


def _digits(low: int, high: int) -> Callable[[str], bool | None]:
    return lambda text: False if low <= len(digits_of(text)) <= high else None


def _security(text: str) -> bool | None:
    area, group, serial = text.split("-")
    return False if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None


NUMBERS = _words("order invoice part item version serial ticket isbn issue page")
DIGIT_RUNS = _found(r"[0-9](?:[ -]?[0-9])++")

BASE: tuple[Kind, ...] = (
    Kind("email", emails, lambda text: False, 0.8, _words("email mail contact write address"), mark="@"),
    Kind("ip", _found(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), _address, 0.6, _words("ip address host server client login"), _words("version release section chapter"), mark="."),
    Kind("card", DIGIT_RUNS, _card(16, 19), 0.5, _words("card visa mastercard credit debit payment pay"), NUMBERS),
    Kind("phone", _found(r"\+[0-9][ ().0-9-]+[0-9]"), _digits(8, 15), 0.6, _words("phone tel telephone call mobile cell fax whatsapp"), NUMBERS, mark="+"),
)
#: Kinds beside the base. A checksum or a telling word has to speak for each.
MORE: tuple[Kind, ...] = (
    Kind("iban", accounts, lambda text: True, 0.4, _words("iban account bank transfer konto compte cuenta"), NUMBERS),
    Kind("short_card", DIGIT_RUNS, _card(13, 15), 0.1, _words("card amex express credit debit diners payment"), NUMBERS),
    Kind("national_phone", _found(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"), _digits(10, 10), 0.3, _words("phone tel telephone call mobile cell fax ring"), NUMBERS),
    Kind("social_security", _found(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), _security, 0.3, _words("ssn social security"), NUMBERS),
    Kind("birth_date", _found(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-]|\.[0-9])"), lambda text: False, 0.3, _words("born birth birthday birthdate dob geboren né née nacido nacida")),
)

Span = tuple[int, int, int, float]


def _proposals(kind: Kind, text: str) -> Iterator[tuple[int, int, float]]:
    if kind.mark in text:
        for begin, end in kind.spans(text):
            if (confirmed := kind.valid(text[begin:end])) is not None:
                yield begin, end, kind.score(text, begin, end, confirmed)


def find_spans(text: str | None, least: float = LEAST) -> list[Span]:
    """(number of the kind, begin, end, score) by kind, then begin; base kinds come first."""
    text = text or ""
    out = [(0, *p) for p in _proposals(BASE[0], text)]
    if not DIGITS.search(text):
        return out
    out += [(n, *p) for n, kind in enumerate(BASE) if n for p in _proposals(kind, text)]
    taken = sorted((b, e) for _, b, e, _ in out)
    begins = np.array([b for b, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else begins

    def free(begin: int, end: int) -> bool:
        k = int(np.searchsorted(begins, end, "left"))  # of the spans that begin before its end none reaches into it
        return not k or reach[k - 1] <= begin

    for n, kind in enumerate(MORE, len(BASE)):
        out += [(n, b, e, s) for b, e, s in _proposals(kind, text) if s >= least and free(b, e)]
    return out


NAMES = [k.name for k in BASE + MORE]
SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def _finder(least: float, kinds: pa.Schema):
    names = pa.array(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [find_spans(t.as_py(), least) for t in batch.column(1)]
            flat = [s for some in found for s in some]
            number, begin, end, score = zip(*flat, strict=True) if flat else ([], [], [], [])
            number = np.array(number, np.int64)
            cells = [names.take(pa.array(number)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64()), pa.array(number < len(BASE))]
            spans = pa.StructArray.from_arrays(cells, ["kind", "start", "end", "score", "base"])
            offsets = pa.array(np.cumsum([0] + [len(some) for some in found]), pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, spans)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id_col, spans): every span of each row's text with its kind, place and score; base kinds first, then by place."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = StructType([rows.schema[0], *StructType.fromDDL(f"spans {SPANS}").fields])
    return rows.mapInArrow(_finder(least, to_arrow_schema(schema)), schema)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("b"), s["end"].alias("e"), s["kind"].alias("k"))))

    def add(state: Column, s: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), (s["b"] - state["at"]).cast("int"))
        out = F.when(s["b"] >= state["at"], F.concat(state["out"], before, F.lit("["), s["k"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["e"]).alias("at"), out.alias("out"))

    done = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(text.isNotNull(), F.aggregate(placed, empty, add, done))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")
