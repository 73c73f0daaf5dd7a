"""Licence scans by template-markup matching.

A template is wording with markup: ``<<optional: ...>>`` may be left out and
``<<var: a | b>>`` stands for one of its alternatives, ``<<var>>`` for any run of one
to ``MAX_FREE`` words. It is compiled into an automaton over words; a text is
accepted where the automaton gets from its start to its end, that is, where all
mandatory wording stands exactly, in order and without gaps. Texts and templates
are reduced to words in the same way (ASCII lower case, runs of letters, digits
and characters beyond ASCII), so case, punctuation and line breaks do not matter.

All automata run together: a dictionary over the first words of the templates
finds where any of them may start, so nearly all words cost one look-up. There is
no shuffle and no state beyond one text.

Defined results: a null text is empty; matches may overlap; repeated rows get the
same matches; a text without words has none. Columns other than ``text`` are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

#: Fixed value: what a word is, after A-Z became lower case.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MAX_FREE = 12
_MARKUP = re.compile(r"<<(optional:|var:|var(?=>>)|)|(>>)|(\|)")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(_LOWER)) if text else []


@dataclass(frozen=True)
class Template:
    """``label`` for texts that hold ``wording``; ``base`` ones are plain phrases."""

    label: str
    wording: str
    base: bool = False


#: The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

#: Whole licence texts: grant, conditions and disclaimer; free are names and list numbers.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files <<optional: (the "Software")>>, to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<optional: (including the next paragraph)>> shall be included in
all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var: NONINFRINGEMENT | NON-INFRINGEMENT>>.
IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
<<optional: <<var: 1 | a | i>>>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.
<<optional: <<var: 2 | b | ii>>>> Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<optional: <<optional: <<var: 3 | c | iii>>>> <<var: Neither the name of <<var>> nor the names of
<<var: its | their | other | any>> contributors may | Neither the name of <<var>> may | The name of <<var>> may not | The names of <<var>> may not>>
be used to endorse or promote products derived from this software without specific prior written permission.>>
THIS SOFTWARE IS PROVIDED BY <<var>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var>>
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and<<optional: /or>> distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var>> <<var: DISCLAIMS | DISCLAIM>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

#: Short notices, and licence texts as a whole: an altered text has no label.
TEMPLATES = (
    Template("mit-notice", "<<var: released | licensed | distributed | available>> under the "
             "<<optional: terms of the>> MIT <<var: license | licence>>"),
    Template("mit-text", MIT),
    Template("apache-2-notice", "licensed under the Apache License, Version 2.0 "
             "<<optional: (the \"License\")>>"),
    Template("bsd-text", BSD),
    Template("isc-text", ISC),
    Template("gpl-notice", "GNU <<optional: <<var: Lesser | Library | Affero>>>> General Public "
             "<<var: License | Licence>> <<optional: as published by the Free Software Foundation>>, "
             "<<optional: either>> version <<var: 1 | 2 | 3 | 2.0 | 2.1 | 3.0>>"),
    Template("mpl-2-notice", "subject to the terms of the Mozilla Public License, <<optional: v. | version>> 2.0"),
    Template("cc-notice", "licensed under <<optional: a | the>> <<var: CC | Creative Commons>> "
             "<<var: BY | Attribution>> <<optional: <<var: NC | NonCommercial | SA | ShareAlike | ND | NoDerivatives>>>> "
             "<<optional: <<var: SA | ShareAlike | ND | NoDerivatives>>>> "
             "<<optional: <<var: 1.0 | 2.0 | 2.5 | 3.0 | 4.0>>>>"),
    Template("copyright-notice", "all rights reserved"),
)


class Automaton:
    """States 0 to ``end``; ``steps[state][word]`` and ``skips[state]`` lead on.

    ``free[state]`` leads on over any word. Skips are resolved when it is built.
    """

    def __init__(self, wording: str):
        self._arcs: list[tuple[int, str | None, int]] = []
        self._skips: list[tuple[int, int]] = []
        self._states = 1
        self._tokens = self._lex(wording)
        self._at = 0
        self.end = self._alternatives(0, closed=False)
        self._build()

    @staticmethod
    def _lex(wording: str) -> list[str]:
        out, last = [], 0
        for m in _MARKUP.finditer(wording):
            out += words(wording[last:m.start()])
            out.append(m.group(0) if m.group(2) or m.group(3) else f"<<{m.group(1).rstrip(':')}")
            last = m.end()
        return out + words(wording[last:])

    def _state(self) -> int:
        self._states += 1
        return self._states - 1

    def _alternatives(self, start: int, closed: bool) -> int:
        """Sequences separated by ``|`` from ``start``, up to ``>>`` if ``closed``."""
        ends, at = [], start
        while self._at < len(self._tokens):
            token = self._tokens[self._at]
            self._at += 1
            if token == ">>":
                if not closed:
                    raise ValueError("markup is closed but not open")
                break
            if token == "|":
                ends.append(at)
                at = start
            elif token in ("<<optional", "<<var"):
                free = token == "<<var" and self._tokens[self._at: self._at + 1] == [">>"]
                if free:
                    self._at += 1
                    to, passed = at, []
                    for _ in range(MAX_FREE):
                        following = self._state()
                        self._arcs.append((to, None, following))
                        to = following
                        passed.append(to)
                    # Any of the steps may be the last.
                    self._skips += [(p, to) for p in passed[:-1]]
                else:
                    inner = self._state()
                    self._skips.append((at, inner))
                    to = self._alternatives(inner, closed=True)
                    if token == "<<optional":
                        self._skips.append((inner, to))
                at = to
            elif token == "<<":
                raise ValueError("unknown markup")
            else:
                to = self._state()
                self._arcs.append((at, token, to))
                at = to
        else:
            if closed:
                raise ValueError("markup is open at the end")
        ends.append(at)
        if len(ends) == 1:
            return at
        end = self._state()
        self._skips += [(e, end) for e in ends]
        return end

    def _build(self) -> None:
        reach = [{s} for s in range(self._states)]
        changed = True
        while changed:
            changed = False
            for a, b in self._skips:
                if not reach[b] <= reach[a]:
                    reach[a] |= reach[b]
                    changed = True
        steps: list[dict[str, set[int]]] = [{} for _ in range(self._states)]
        free: list[set[int]] = [set() for _ in range(self._states)]
        for s in range(self._states):
            for a, word, b in self._arcs:
                if a in reach[s]:
                    (free[s] if word is None else steps[s].setdefault(word, set())).add(b)
        self.steps, self.free = steps, free
        self.accepting = {s for s in range(self._states) if self.end in reach[s]}
        if 0 in self.accepting:
            raise ValueError("a template needs mandatory wording")

    def first(self) -> set[str]:
        if self.free[0]:
            raise ValueError("a template begins with wording")
        return set(self.steps[0])

    def longest(self, text: Sequence[str], start: int) -> int | None:
        """End of the longest match that begins at ``start``."""
        now, end = {0}, None
        for i in range(start, len(text)):
            word = text[i]
            now = {t for s in now for t in (*self.steps[s].get(word, ()), *self.free[s])}
            if not now:
                break
            if now & self.accepting:
                end = i + 1
        return end


class Scanner:
    """Templates compiled together."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self._starts: dict[str, list[tuple[int, Automaton]]] = {}
        for i, t in enumerate(self.templates):
            automaton = Automaton(t.wording)
            for word in automaton.first():
                self._starts.setdefault(word, []).append((i, automaton))

    def scan(self, text: Sequence[str]) -> list[tuple[int, int, int]]:
        """(template, start, end) of every match, in order of start, then template."""
        starts = self._starts
        out = []
        for i, found in [(i, starts[w]) for i, w in enumerate(text) if w in starts]:
            for k, automaton in found:
                end = automaton.longest(text, i)
                if end is not None:
                    out.append((k, i, end))
        return sorted(out, key=lambda m: (m[1], m[0]))


MATCHES = ArrayType(StructType([
    StructField("label", StringType()), StructField("base", IntegerType()),
    StructField("start", LongType()), StructField("end", LongType())]))


def scanned(docs: DataFrame, templates: Sequence[Template] = BASE + TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches`` (label, base, start and end in words)."""
    Scanner(templates)  # templates are checked before any task runs
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_words", "matches")])
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("matches", MATCHES)])
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        names = [(t.label, int(t.base)) for t in scanner.templates]
        for b in batches:
            sizes, found = [], []
            for text in b.column(at).to_pylist():
                w = words(text)
                sizes.append(len(w))
                found.append([
                    {"label": names[k][0], "base": names[k][1], "start": s, "end": e}
                    for k, s, e in scanner.scan(w)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sizes, pa.int64()), pa.array(found, kind)],
                [*b.schema.names, "n_words", "matches"])

    return docs.mapInArrow(scan, schema)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS j,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'under' AND ws[i + 2] = 'the' AND ws[i + 3] = 'mit' AND ws[i + 4] = 'license') AS m,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license' AND ws[i + 3] = 'version' AND ws[i + 4] = '2') AS a,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'cc' AND ws[i + 2] = 'by' AND ws[i + 3] = 'nc') AS c FROM w),
l AS (SELECT *, list_concat(list_concat(m, a), c) AS p, list_filter([
    CASE WHEN len(m) > 0 THEN 'mit' END, CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END],
    lambda x: x IS NOT NULL) AS bl, list_filter([
    CASE WHEN regexp_matches(j, ' (released|licensed|distributed|available) under the (terms of the )?mit (license|licence) ') THEN 'mit-notice' END,
    CASE WHEN regexp_matches(j, ' permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software )?to deal in the software without restriction ') THEN 'mit-text' END,
    CASE WHEN regexp_matches(j, ' licensed under the apache license version 2 0 ') THEN 'apache-2-notice' END,
    CASE WHEN regexp_matches(j, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ') THEN 'bsd-text' END,
    CASE WHEN regexp_matches(j, ' permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted ') THEN 'isc-text' END,
    CASE WHEN regexp_matches(j, ' gnu ((lesser|library|affero) )?general public (license|licence) (as published by the free software foundation )?(either )?version (1|2|3|2 0|2 1|3 0) ') THEN 'gpl-notice' END,
    CASE WHEN regexp_matches(j, ' subject to the terms of the mozilla public license ((v|version) )?2 0 ') THEN 'mpl-2-notice' END,
    CASE WHEN regexp_matches(j, ' licensed under ((a|the) )?(cc|creative commons) (by|attribution) ') THEN 'cc-notice' END,
    CASE WHEN regexp_matches(j, ' all rights reserved ') THEN 'copyright-notice' END], lambda x: x IS NOT NULL) AS ml FROM t)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word,
    list_max(p)::BIGINT AS last_word, array_to_string(list_sort(bl), ',') AS base_labels,
    array_to_string(list_sort(list_concat(bl, ml)), ',') AS labels,
    CASE WHEN len(ml) > 0 THEN 1.0::DOUBLE WHEN len(bl) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM l
"""
