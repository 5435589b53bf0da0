"""License scans: templates with optional and replaceable regions, compiled into token automata.

Markup: plain words are mandatory; [[...]] is optional; {{a|b c}} is replaceable by any of its alternatives; <<n>> by up to n
words of any kind. Regions nest. A template becomes an automaton over words with empty moves; a text is accepted at a
place where the automaton reaches its end, so everything mandatory stands there exactly, in order and with nothing else
between but what regions allow. Only texts with all mandatory words of a template are run through its automaton, and
only from its possible first words, which changes no result. Fixed phrases are found beside the templates.

Defined results: null and empty texts have no words, no labels and score 0. Null or repeated ids are rows like any other. Of
several accepted ends from one place the longest is taken. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import HASH

# The words of a text are runs of 0-9, a-z and everything from code point 128.
SEPARATORS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public license notices and texts, with all conditions and the disclaimer. Names of holders are
# replaceable, marks of list items optional; quotation marks beyond ASCII belong to their word.
COPYRIGHT = "[[copyright <<12>>]]"
AS_IS = "{{as is|“as is”}}"
BULLET = "[[{{1|2|3|4|a|b|c|d|i|ii|iii|iv|•}}]]"
BSD_START = f"{COPYRIGHT} redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {BULLET} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {BULLET} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NAMES = "{{neither the name of <<12>> nor the names of {{its|<<3>>}} contributors may|the name of the author may not}} be used to endorse or promote products derived from this software without specific prior written permission"
BSD_END = f"this software is provided by {{{{the copyright holders and contributors|<<12>>}}}} {AS_IS} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{{{the copyright holder or contributors|<<12>>}}}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
GPL_VERSION = "{{either version {{2|2 1|3}} of the license or [[at your option]] any later version|version {{2|2 1|3}} of the license|version {{2|2 1|3}}}}"
NO_WARRANTY = "<<5>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the"
TEMPLATES = {
    "mit-notice": "{{released|licensed|available|distributed|provided}} under the [[terms of the]] mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]",
    "cc-by-nc-4.0-notice": "licensed under [[{{a|the}}]] {{cc|creative commons}} {{by nc|attribution noncommercial|attribution non commercial}} 4 0 [[international]] [[license]]",
    "mit": f"{COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy of this {{{{software and associated documentation files the software|<<8>>}}}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided {AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {{{{noninfringement|non infringement}}}} in no event shall {{{{the authors or copyright holders|<<12>>}}}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause": f"{BSD_START} {BSD_END}",
    "bsd-3-clause": f"{BSD_START} {BULLET} {BSD_NAMES} {BSD_END}",
    "bsd-4-clause": f"{BSD_START} {BULLET} all advertising materials mentioning features or use of this software must display the following {{{{acknowledgement|acknowledgment}}}} this product includes software developed by <<20>> {BULLET} {BSD_NAMES} {BSD_END}",
    "isc": f"{COPYRIGHT} permission to use copy modify and {{{{or|}}}} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided {AS_IS} and {{{{the author|<<8>>}}}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{{{the author|<<8>>}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "apache-2.0": f"{COPYRIGHT} licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{{{http|https}}}} www apache org licenses license 2 0 [[{{{{txt|html}}}}]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an {AS_IS} basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": f"is free software {{{{you can|you may}}}} redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {GPL_VERSION} {NO_WARRANTY} gnu general public license for more details",
    "lgpl-notice": f"is free software {{{{you can|you may}}}} redistribute it and or modify it under the terms of the gnu {{{{lesser|library}}}} general public license as published by the free software foundation {GPL_VERSION} {NO_WARRANTY} gnu {{{{lesser|library}}}} general public license for more details",
    "agpl-notice": f"is free software {{{{you can|you may}}}} redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation {GPL_VERSION} {NO_WARRANTY} gnu affero general public license for more details",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{http|https}} {{mozilla|www mozilla}} org mpl 2 0",
    "unlicense": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided {AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib": f"{COPYRIGHT} this software is provided {{{{as is|“as is”|‘as is’}}}} without any express or implied warranty in no event will the {{{{author|authors}}}} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {BULLET} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {BULLET} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {BULLET} this notice may not be removed or altered from any source distribution",
}


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(SEPARATORS).split()


@dataclass
class Automaton:
    """States 0.. with word moves, moves on any word and empty moves."""

    moves: list[dict[bytes, set[int]]] = field(default_factory=list)
    any_moves: list[set[int]] = field(default_factory=list)
    empty: list[set[int]] = field(default_factory=list)
    mandatory: set[bytes] = field(default_factory=set)
    end: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.any_moves.append(set())
        self.empty.append(set())
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()] - out:
                out.add(t)
                todo.append(t)
        return out

    def first_words(self) -> set[bytes] | None:
        """The words a match can start with; None if any."""
        start = self.closed({0})
        return None if any(self.any_moves[s] for s in start) else {w for s in start for w in self.moves[s]}

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted match that starts at `at`, or -1."""
        states, last, k = self.closed({0}), -1, at
        while states:
            if self.end in states:
                last = k
            if k == len(words):
                break
            states = self.closed({t for s in states for t in self.moves[s].get(words[k], set()) | self.any_moves[s]})
            k += 1
        return last


def compile_template(markup: str) -> Automaton:
    """The automaton of a markup; a ValueError where regions are not closed, not opened or not of a kind."""
    tokens = re.findall(r"\[\[|\]\]|\{\{|\}\}|\||<<\d+>>|[^\s\[\]{}|<>]+|[\[\]{}<>]", markup)
    auto, at = Automaton(), 0

    def expect(*marks: str) -> str:
        nonlocal at
        if at == len(tokens) or tokens[at] not in marks:
            raise ValueError(f"expected {' or '.join(marks)}, not {tokens[at] if at < len(tokens) else 'the end'!r} in {markup[:80]!r}")
        at += 1
        return tokens[at - 1]

    def sequence(start: int, depth: int) -> int:
        nonlocal at
        here = start
        while at < len(tokens) and tokens[at] not in ("]]", "}}", "|"):
            token = tokens[at]
            at += 1
            if token == "[[":
                after = sequence(here, depth + 1)
                expect("]]")
                auto.empty[here].add(after)
                here = after
            elif token == "{{":
                done = auto.state()
                while True:
                    begin = auto.state()
                    auto.empty[here].add(begin)
                    auto.empty[sequence(begin, depth + 1)].add(done)
                    if expect("}}", "|") == "}}":
                        break
                here = done
            elif token.startswith("<<"):
                for _ in range(int(token[2:-2])):
                    after = auto.state()
                    auto.any_moves[here].add(after)
                    auto.empty[here].add(after)
                    here = after
            elif token in ("[", "]", "{", "}", "<", ">"):
                raise ValueError(f"{token!r} is no word and opens no region in {markup[:80]!r}")
            else:
                after = auto.state()
                auto.moves[here].setdefault(token.encode(), set()).add(after)
                if not depth:
                    auto.mandatory.add(token.encode())
                here = after
        return here

    auto.end = sequence(auto.state(), 0)
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} closes or parts no region in {markup[:80]!r}")
    return auto


class LicenseScanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = [(label, auto := compile_template(t), auto.first_words()) for label, t in templates.items()]
        self.phrases = [([HASH[w.encode()] for w in phrase.split()], label) for phrase, label in phrases.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(words, places of phrases, accepted templates); places are (start, end, label)."""
        words = license_words(text)
        hashes = HASH.array(words)
        base, accepted = [], []
        for want, label in self.phrases:
            n = len(hashes) - len(want) + 1
            if n > 0:
                hit = np.logical_and.reduce([hashes[k : k + n] == np.uint64(h) for k, h in enumerate(want)])
                base += [(p, p + len(want), label) for p in np.flatnonzero(hit).tolist()]
        held = set(words)
        for label, auto, first in self.automata:
            if not auto.mandatory <= held:
                continue
            starts = range(len(words)) if first is None else np.flatnonzero(np.isin(hashes, np.array([HASH[w] for w in first], np.uint64))).tolist()
            for p in starts:
                if (end := auto.longest(words, p)) > p:
                    accepted.append((p, end, label))
        return len(words), sorted(base), sorted(accepted)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches): score is the share of the words inside a match."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner()
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, base, accepted = scanner.scan(text.as_py())
                places = base + accepted
                inside = np.zeros(n if places else 0, bool)
                for a, b, _ in places:
                    inside[a:b] = True
                out.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in places})), float(inside.mean()) if places else 0.0, [{"start": a, "end": b, "label": x} for a, b, x in accepted]))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start:long,end:long,label:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
