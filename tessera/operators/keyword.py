"""Full-text search: positional postings, the query language, BM25 and snippets.

A query is parsed on the driver into a tree of phrases. Without an index each document's tokens are looked through where they
are: phrase positions are array expressions, so nothing is shuffled but one row of counts and the best rows. With an
index postings are filtered to the terms of the query first, phrases are found by equality joins on consecutive
positions, and one aggregation by document counts them. The tree's condition and the score are then plain column
expressions over phrase counts.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import parsing

#: plain: words in lower case. porter: also without diacritics and stemmed, as SQLite's 'porter unicode61'.
ANALYSERS = ("plain", "porter")
FIELDS = ("subject", "from_name", "from_address", "body_text", "attachment_names", "attachment_text")
TOKEN = r"[\p{L}\p{N}]+"
#: Widest proximity that is tested by the sets of places where a span can end.
CLOSE = 100
K1, B, LEAST_IDF, NEAR_DEFAULT = 1.2, 0.75, 1e-6, 10
ADVANCED = re.compile(r'["():*^]| AND | OR | NOT | NEAR\(|^NOT ')


class QuerySyntaxError(ValueError):
    """The query is not in the language or names an unknown column."""


def tokens(c: str | Column, analyser: str = "plain") -> Column:
    if analyser == "porter":
        return parsing.column(parsing.porter_tokens, "array<string>", c, shared=True)
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def split_words(text: str) -> list[str]:
    """The words of a query: letters and digits."""
    return re.findall(r"[^\W_]+", text)


def terms_of(text: str, analyser: str = "plain") -> list[str]:
    """Index terms of a piece of a query."""
    if analyser == "porter":
        return parsing.porter_tokens(text)
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if any(unicodedata.category(c)[0] in "LN" for c in w)]


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    anchored: bool = False
    fields: tuple[str, ...] = FIELDS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple = field(default=())


class _Parser:
    TOKENS = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(NEAR)\s*\(|([(){}:*^+,-])|([^\s"(){}:*^+,-]+))')

    def __init__(self, text: str, fields: tuple[str, ...], analyser: str = "plain"):
        self.fields, self.analyser, self.items, at = fields, analyser, [], 0
        text = text.rstrip()
        while at < len(text):
            m = self.TOKENS.match(text, at)
            if not m:
                raise QuerySyntaxError(f"unreadable at {at}")
            at = m.end()
            quoted, near, mark, word = m.groups()
            if word is not None and not re.fullmatch(r"[\w\x80-\U0010ffff]+", word):
                raise QuerySyntaxError(f"a word can't be {word!r}")
            self.items.append(("str", quoted.replace('""', '"')) if quoted is not None else ("near", None) if near else ("mark", mark) if mark else ("word", word))
        self.at = 0

    def peek(self, k: int = 0):
        return self.items[self.at + k] if self.at + k < len(self.items) else (None, None)

    def take(self, kind: str, value: str | None = None):
        got = self.peek()
        if got[0] != kind or (value is not None and got[1] != value):
            raise QuerySyntaxError(f"expected {value or kind}, got {got[1]}")
        self.at += 1
        return got[1]

    def parse(self):
        out = self.either(self.fields)
        if self.at < len(self.items):
            raise QuerySyntaxError(f"left over: {self.peek()[1]}")
        return out

    def _level(self, word: str, below, fields):
        parts = [below(fields)]
        while self.peek() == ("word", word):
            self.at += 1
            parts.append(below(fields))
        return parts[0] if len(parts) == 1 else Op(word, tuple(parts))

    def either(self, fields):
        return self._level("OR", self.both, fields)

    def both(self, fields):
        return self._level("AND", self.without, fields)

    def without(self, fields):
        out = self.adjacent(fields)
        while self.peek() == ("word", "NOT"):
            self.at += 1
            out = Op("NOT", (out, self.adjacent(fields)))
        return out

    def adjacent(self, fields):
        parts = [self.unit(fields)]
        while (kind := self.peek())[0] in ("str", "near") or (kind[0] == "word" and kind[1] not in ("AND", "OR", "NOT")) or kind in (("mark", "("), ("mark", "{"), ("mark", "^"), ("mark", "-")):
            parts.append(self.unit(fields))
        return parts[0] if len(parts) == 1 else Op("AND", tuple(parts))

    def _columns(self, fields):
        """A column filter before an expression, if there is one."""
        start, names, negate = self.at, [], False
        if self.peek() == ("mark", "-"):
            negate = True
            self.at += 1
        if self.peek() == ("mark", "{"):
            self.at += 1
            while self.peek() != ("mark", "}"):
                names.append(self.take("word"))
            self.at += 1
        elif self.peek()[0] in ("word", "str") and self.peek(1) == ("mark", ":"):
            names.append(self.items[self.at][1])
            self.at += 1
        if not names or self.peek() != ("mark", ":"):
            if negate or names:
                raise QuerySyntaxError("a column filter needs a column and a colon")
            self.at = start
            return None
        self.at += 1
        if unknown := [n for n in names if n.lower() not in FIELDS]:
            raise QuerySyntaxError(f"no such column: {unknown[0]}")
        low = {n.lower() for n in names}
        return tuple(f for f in fields if (f in low) != negate)

    def unit(self, fields):
        if (chosen := self._columns(fields)) is not None:
            return self.unit(chosen)
        kind, value = self.peek()
        if (kind, value) == ("mark", "("):
            self.at += 1
            out = self.either(fields)
            self.take("mark", ")")
            return out
        if kind == "near":
            self.at += 1
            phrases, within = [], NEAR_DEFAULT
            while self.peek() not in (("mark", ")"), ("mark", ",")):
                if self.peek() == ("mark", "^"):
                    raise QuerySyntaxError("no phrase inside NEAR can be anchored")
                phrases.append(self.phrase(fields))
            if self.peek() == ("mark", ","):
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                within = int(number)
            self.take("mark", ")")
            if not phrases:
                raise QuerySyntaxError("NEAR needs phrases")
            return Near(tuple(phrases), within)
        return self.phrase(fields)

    def phrase(self, fields):
        anchored = self.peek() == ("mark", "^")
        self.at += anchored
        terms: list[str] = []
        while True:
            kind, value = self.peek()
            if kind not in ("str", "word") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise QuerySyntaxError(f"expected a phrase, got {value}")
            self.at += 1
            terms += terms_of(value, self.analyser)
            if self.peek() != ("mark", "+"):
                break
            self.at += 1
        prefix = self.peek() == ("mark", "*")
        self.at += prefix
        return Phrase(tuple(terms), prefix, anchored, fields)


def or_of_words(query: str, analyser: str = "plain") -> Op | Phrase | None:
    """Natural language: any of its words."""
    words = split_words(parsing.fold_latin(query) if analyser == "porter" else query)  # a combining mark parts no word
    phrases = tuple(Phrase(t) for w in words if (t := tuple(terms_of(w, analyser))))
    return None if not phrases else phrases[0] if len(phrases) == 1 else Op("OR", phrases)


def parse_query(query: str, analyser: str = "plain"):
    """The tree of a query: as it is written where it uses the language, else any of its words; None finds nothing.

    A query that is no well-formed expression falls back to any of its words.
    """
    if not query or not query.strip():
        return None
    if analyser not in ANALYSERS:
        raise ValueError(f"the analyser is one of {', '.join(ANALYSERS)}")
    if not ADVANCED.search(query):
        return or_of_words(query, analyser)
    try:
        return _Parser(query, FIELDS, analyser).parse()
    except QuerySyntaxError:
        return or_of_words(query, analyser)


def _cells(docs: DataFrame, fields: tuple[str, ...], analyser: str) -> DataFrame:
    """(id, cells): the tokens of each field of a document.

    Explode them outer: of a plain explode Spark makes a filter that the array is not empty, below this, which cuts the texts a second time.
    """
    have = [f for f in fields if f in docs.columns]
    return docs.select("id", F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit("")), analyser).alias("t")) for f in have)).alias("cells"))


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, analyser: str = "plain") -> DataFrame:
    """(id, field, term, pos, len) of all token positions; len is that of the whole document."""
    cells = _cells(docs, fields, analyser)
    length = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.size(x["t"]))
    cells = cells.select("id", length.alias("len"), F.explode_outer("cells").alias("c"))
    return cells.select("id", "len", "c.field", F.posexplode("c.t").alias("pos", "term")).select("id", "field", "term", "pos", "len")


def field_totals(docs: DataFrame, fields: tuple[str, ...] = FIELDS, analyser: str = "plain") -> DataFrame:
    """(id, field, n, first_term, last_pos) of the postings; a row's are added up where it stands, so a row a field is shuffled."""
    cells = _cells(docs, fields, analyser).select("id", F.explode_outer("cells").alias("c")).filter(F.size("c.t") > 0)
    parts = cells.select("id", "c.field", F.size("c.t").cast("long").alias("n"), F.array_min("c.t").alias("first_term"), (F.size("c.t") - 1).alias("last_pos"))
    return parts.groupBy("id", "field").agg(F.sum("n").alias("n"), F.min("first_term").alias("first_term"), F.max("last_pos").alias("last_pos"))


#: Ids that stand in several rows and are looked up by value; more are joined.
LOOKED_UP = 1000


def vocabulary(docs: DataFrame, fields: tuple[str, ...] = FIELDS, analyser: str = "plain") -> DataFrame:
    """(term, n, docs): places of each term, and the different ids that have it.

    A row's tokens are sorted where they stand, and the first of each term counts for its id. So terms are counted without a set of ids;
    only ids that stand in several rows, which are looked for first, are counted as such. A null id is no id.
    """
    again = docs.filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    few = [r.id for r in again.limit(LOOKED_UP + 1).collect()]

    def rows(some: DataFrame) -> DataFrame:
        sorted_ = F.array_sort(F.flatten(F.transform("cells", lambda c: c["t"])))
        cut = _cells(some, fields, analyser).select("id", sorted_.alias("t"))
        return cut.select("id", F.posexplode_outer("t").alias("at", "term"), "t").filter("term is not null").select("id", "term", ((F.col("at") == 0) | (F.get("t", F.col("at") - 1) != F.col("term"))).alias("first"))

    if not few:
        once, repeated = docs, None
    elif len(few) <= LOOKED_UP:
        once, repeated = docs.filter(~F.coalesce(F.col("id").isin(few), F.lit(False))), docs.filter(F.col("id").isin(few))
    else:
        once, repeated = docs.join(again, "id", "left_anti"), docs.join(again, "id", "left_semi")
    out = rows(once).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") & F.col("id").isNotNull()).alias("docs"))
    if repeated is None:
        return out
    more = rows(repeated).groupBy("term", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    return out.unionByName(more).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return [p for x in (node.phrases if isinstance(node, Near) else node.parts) for p in _phrases(x)]


def snippet_phrases(tree, fields: list[str] | tuple[str, ...]) -> list[tuple[tuple[str, ...], bool, bool, tuple[int, ...]]]:
    """The phrases of a query as parsing.best_snippet() takes them; fields are those of its cells."""
    return [(p.terms, p.prefix, p.anchored, tuple(k for k, f in enumerate(fields) if f in p.fields)) for p in _phrases(tree)]


def _wanted(term: Column, phrases: list[Phrase]) -> Column:
    whole = {t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)}
    tests = [term.isin(*sorted(whole))] if whole else []
    tests += [term.startswith(p.terms[-1]) for p in phrases if p.prefix and p.terms]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def _occurrences(index: DataFrame, p: Phrase, number: int) -> DataFrame:
    """(id, field, pos, len, phrase) of the phrase's first word."""
    out = None
    for k, term in enumerate(p.terms):
        last = k == len(p.terms) - 1
        hit = index.filter(F.col("term").startswith(term) if p.prefix and last else F.col("term") == term)
        hit = hit.select("id", "field", (F.col("pos") - k).alias("pos"), *(["len"] if not k else []))
        out = hit if out is None else out.join(hit, ["id", "field", "pos"])
    if out is None:
        return index.filter(F.lit(False)).select("id", "field", "pos", "len", F.lit(number).alias("phrase"))
    if p.fields != FIELDS:
        out = out.filter(F.col("field").isin(*p.fields))
    if p.anchored:
        out = out.filter("pos = 0")
    return out.select("id", "field", "pos", "len", F.lit(number).alias("phrase"))


def _nodes(node, kind) -> list:
    """The nodes of a kind, in the order of the query."""
    if isinstance(node, kind):
        return [node]
    return [x for part in getattr(node, "parts", ()) for x in _nodes(part, kind)]


def _near_counts(places: list[Column], lengths: list[int], within: int) -> Column:
    """How many places of each phrase take part in a span: an array of one number a phrase, all 0 or none.

    A span ends at the place of its last phrase; every phrase of l words begins at most l + within words before that end.
    """
    number, none = range(len(places)), F.array(*(F.lit(0) for _ in places))
    if len(places) == 1:
        return F.array(F.size(places[0]))
    reach = [n + within for n in lengths]

    def spread_over(ends: Column, low: int, high: int) -> Column:
        return F.flatten(F.transform(ends, lambda i: F.sequence(i + low, i + high)))

    def before(places: Column, end: Column, width: int) -> Column:
        return F.exists(places, lambda i: (i <= end) & (i >= end - width))

    def in_spans(places: Column, ends: Column, width: int) -> Column:
        return F.filter(places, lambda i: F.exists(ends, lambda end: (i <= end) & (i >= end - width)))

    def ends_of(x: Column) -> Column:
        """The places at which a span ends."""
        all_places = F.concat(*(x[f"p{j}"] for j in number))
        if within <= CLOSE:  # by the words that can be an end for each phrase, no pairs of places
            return reduce(F.array_intersect, (spread_over(x[f"p{j}"], 0, reach[j]) for j in number), all_places)
        return F.filter(all_places, lambda end: reduce(Column.__and__, (before(x[f"p{j}"], end, reach[j]) for j in number)))

    def taking_part(y: Column) -> Column:
        if within <= CLOSE:
            return F.array(*(F.size(F.array_intersect(y["x"][f"p{j}"], spread_over(y["ends"], -reach[j], 0))) for j in number))
        return F.array(*(F.size(in_spans(y["x"][f"p{j}"], y["ends"], reach[j])) for j in number))

    bound = F.transform(F.array(F.struct(*(p.alias(f"p{j}") for j, p in enumerate(places)))), lambda x: F.struct(x.alias("x"), ends_of(x).alias("ends")))
    return F.when(reduce(Column.__and__, (F.size(p) > 0 for p in places)), F.get(F.transform(bound, taking_part), F.lit(0))).otherwise(none)


def _places(tokens: Column, p: Phrase) -> Column:
    """The places of a phrase in an array of tokens."""
    n, none = len(p.terms), F.array().cast("array<int>")

    def here(i: Column) -> Column:
        tests = [F.get(tokens, i + k).startswith(w) if p.prefix and k == n - 1 else F.get(tokens, i + k) == w for k, w in enumerate(p.terms)]
        return reduce(Column.__and__, tests)

    if p.anchored:
        return F.when((F.size(tokens) >= n) & here(F.lit(0)), F.array(F.lit(0))).otherwise(none)
    return F.when(F.size(tokens) >= n, F.filter(F.sequence(F.lit(0), F.size(tokens) - n), here)).otherwise(none)


def _scanned(docs: DataFrame, phrases: list[Phrase], nears: list[Near], analyser: str) -> DataFrame:
    """(id, len, tf<k>, near<k>) of all documents, from their tokens in place; near<k> counts the phrases of an expression.

    The tokens are bound to a lambda variable: as a plain column the optimizer would put the tokenizer itself into every
    place that reads them.
    """
    have = [f for f in FIELDS if f in docs.columns]

    def count(cell: Column, p: Phrase) -> Column:
        fields = [f for f in have if f in p.fields]
        if not p.terms or not fields:
            return F.lit(0)
        if len(p.terms) == 1 and not p.anchored:
            word = p.terms[0]
            return sum(F.size(F.filter(cell[f], lambda x: x.startswith(word) if p.prefix else x == word)) for f in fields)
        return sum(F.size(_places(cell[f], p)) for f in fields)

    def together(cell: Column, near: Near) -> Column:
        fields = [f for f in have if all(p.terms and f in p.fields for p in near.phrases)]
        parts = F.array(*(_near_counts([_places(cell[f], p) for p in near.phrases], [len(p.terms) for p in near.phrases], near.within) for f in fields))
        none = F.array(*(F.lit(0) for _ in near.phrases))
        return F.aggregate(parts, none, lambda a, x: F.zip_with(a, x, lambda m, n: m + n)) if fields else none

    def counts(cell: Column) -> Column:
        length = sum((F.size(cell[f]) for f in have), F.lit(0)).cast("long").alias("len")
        tfs = [count(cell, p).alias(f"tf{k}") for k, p in enumerate(phrases)]
        return F.struct(length, *tfs, *(together(cell, x).alias(f"near{k}") for k, x in enumerate(nears)))

    cut = [tokens(F.coalesce(F.col(f), F.lit("")), analyser).alias(f) for f in have]
    if analyser == "porter":  # Python columns stand in a step of their own
        docs, cut = docs.select("id", *cut), [F.col(f) for f in have]
    return docs.select("id", F.inline(F.transform(F.array(F.struct(*cut)), counts)))


def _looked_up(index: DataFrame, phrases: list[Phrase], nears: list[Near]) -> DataFrame:
    """The same from postings (id, field, term, pos, len), of the documents that hold any of the phrases."""
    index = index.filter(_wanted(F.col("term"), phrases))
    found = reduce(DataFrame.unionByName, (_occurrences(index, p, k) for k, p in enumerate(phrases)))
    counts = found.groupBy("id").agg(F.max("len").alias("len"), *(F.count_if(F.col("phrase") == k).alias(f"tf{k}") for k in range(len(phrases))))
    for k, near in enumerate(nears):
        joined = None
        for j, p in enumerate(near.phrases):
            part = _occurrences(index, p, 0).groupBy("id", "field").agg(F.collect_list("pos").alias(f"p{j}"))
            joined = part if joined is None else joined.join(part, ["id", "field"])
        number = range(len(near.phrases))
        found = joined.select("id", _near_counts([F.col(f"p{j}") for j in number], [len(p.terms) for p in near.phrases], near.within).alias("n"))
        found = found.groupBy("id").agg(*(F.sum(F.get("n", F.lit(j))).alias(f"n{j}") for j in number))
        counts = counts.join(found.select("id", F.array(*(f"n{j}" for j in number)).alias(f"near{k}")), "id", "left")
    return counts


def match(docs: DataFrame | None, query: str | Op | Phrase | Near, index=None, analyser: str = "plain") -> DataFrame:
    """(id, score): documents that satisfy the query, lower scores better.

    The counts behind the score are of all documents given or indexed, live or not. index is a KeywordIndex,
    and what it was built with goes before analyser. Phrases given as a tree hold terms of the analyser.
    """
    analyser = analyser if index is None else index.analyser
    tree = parse_query(query, analyser) if isinstance(query, str) else query
    if tree is None:
        rows = docs if docs is not None else index.postings
        return rows.select("id", F.lit(0.0).alias("score")).filter(F.lit(False))
    phrases, nears = _phrases(tree), _nodes(tree, Near)
    number, leaves, near_no, counted = range(len(phrases)), iter(range(len(phrases))), iter(range(len(nears))), {}
    taking_part: dict[int, Column] = {}  # a phrase counts where it is near the others; how rare it is goes by all its places

    def holds(node) -> Column:
        """The condition of a node; a phrase counts in a document where all expressions around it hold."""
        if isinstance(node, Phrase):
            k = next(leaves)
            counted[k] = F.lit(True)
            return F.col(f"tf{k}") > 0
        if isinstance(node, Near):
            found = F.col(f"near{next(near_no)}")
            out = F.coalesce(F.get(found, F.lit(0)) > 0, F.lit(False))
            for j in range(len(node.phrases)):
                k = next(leaves)
                counted[k], taking_part[k] = out, F.get(found, F.lit(j))
            return out
        before = set(counted)
        first, *rest = [holds(x) for x in node.parts]
        if node.kind == "OR":
            return reduce(Column.__or__, rest, first)
        out = first & ~rest[0] if node.kind == "NOT" else reduce(Column.__and__, rest, first)
        counted.update({k: c & out for k, c in counted.items() if k not in before})
        return out

    condition = holds(tree)
    dfs = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in number]
    if index is None:
        rows = _scanned(docs, phrases, nears, analyser)
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen"), *dfs)
    else:
        rows = _looked_up(index.postings, phrases, nears)
        stats = rows.agg(F.lit(index.n).alias("n"), F.lit(index.avglen).alias("avglen"), *dfs)
    rows = rows.filter(condition).join(F.broadcast(stats))

    def part(k: int) -> Column:
        idf = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.when(counted[k], taking_part.get(k, F.col(f"tf{k}"))).otherwise(0)
        return F.when(idf > 0, idf).otherwise(LEAST_IDF) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avglen")))

    return rows.select("id", F.round(-sum((part(k) for k in number), F.lit(0.0)), 9).alias("score"))


def search(docs: DataFrame | None, query: str | Op | Phrase | Near, limit: int = 20, keep: DataFrame | None = None, index=None, analyser: str = "plain") -> DataFrame:
    """The `limit` best documents among those of keep (live and filtered ones), which leaves the counts as they are."""
    hits = match(docs, query, index, analyser)
    if keep is not None:
        hits = hits.join(keep.select("id"), "id", "left_semi")
    return hits.orderBy("score", "id").limit(limit)
