"""License scans by template-markup matching.

A template is the wording of a license notice or text with marked regions: `[ ... ]` may be missing,
`( a | b )` may read either way, and `{n,m}` may be replaced by n to m words of any kind. A template is
compiled into a token automaton, determinised as it is used; a text matches where the automaton accepts
a run of its words, which it does only if the mandatory wording stands there exactly. The longest literal
run of a template is looked for first, so that texts without it never start the automaton.

The base phrases are counted beside: every place where their words stand consecutively.

A text's label needs the whole wording of that text, notices and headers need theirs; a license whose text runs
over many pages is known by the header or notice that its authors prescribe.

Defined results: a null or empty text has no words, no labels and score 0; a very long text is one line of its
words while it is scanned, and its words are listed only where a template's longest literal run stands in it;
repeated rows, rows that share an id and rows without one are scanned each; an empty table gives an empty result;
extra columns are ignored. Of matches of one template that overlap (ties), the first and longest is reported. The score is 1 with a template's match, 0.5 with base phrases
alone, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ship

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of licenses and notices, as words.
MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"""
MIT_NOTICE = "the above copyright notice and this permission notice"
MIT_KEEP = "shall be included in all copies or substantial portions of the software"
MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BSD_BINARY = """redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution"""
BSD_NAMES = "may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_IMPLIED = "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"
BSD_LIABLE = """be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
ISC_TEXT = """distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission
notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection
with the use or performance of this software"""
ZLIB_TEXT = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the
original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered
source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered
from any source distribution"""
UNLICENSE_TEXT = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that
recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law"""
APACHE_USE = "the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
APACHE_REST = """www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
permissions and limitations under the license"""
GNU_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
GNU_HOPE = """is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu"""
MPL_TEXT = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
obtain one at"""

_GRANTS = "(released|licensed|distributed|made available|available|published)"
_SUBJECT = "[this (work|software|program|project|code|document|file|package|library) is]"
_LATER = "[or [at your option any] later [version]]"


def _bsd(more: str) -> str:
    end = f"this software is provided by (the copyright holders and contributors|{{1,12}}) {BSD_IMPLIED} (the copyright holder or contributors|the copyright owner or contributors|{{1,12}}) {BSD_LIABLE}"
    return f"{BSD_GRANT} [1|a] {BSD_SOURCE} [2|b] {BSD_BINARY} {more} {end}"


def _gnu(name: str) -> str:
    version = "as published by the free software foundation either version {1,2} of the license or at your option any later version"
    return f"(this program|this library|this file|{{1,6}}) {GNU_FREE} {name} {version} (this program|this library|{{1,6}}) {GNU_HOPE} {name} for more details"


TEMPLATES = {
    "mit-notice": f"{_SUBJECT} {_GRANTS} under [the terms of] the mit license",
    "mit-text": f"[the] [mit license] [copyright [c] {{1,12}}] {MIT_GRANT} {MIT_NOTICE} [including the next paragraph] {MIT_KEEP} {MIT_WARRANTY}",
    "apache-2.0": f"{_SUBJECT} {_GRANTS} under [the terms of] the apache license [version] 2 0",
    "apache-2.0-header": f"licensed under the apache license version 2 0 {APACHE_USE} (http|https) {APACHE_REST}",
    "gpl-2.0": f"{_SUBJECT} {_GRANTS} under [the terms of] the [gnu] general public license [v|version] 2 [0] {_LATER}",
    "gpl-3.0": f"{_SUBJECT} {_GRANTS} under [the terms of] the [gnu] general public license [v|version] 3 [0] {_LATER}",
    "gpl-header": _gnu("general public license"),
    "lgpl-header": _gnu("(lesser|library) general public license"),
    "agpl-header": _gnu("affero general public license"),
    "mpl-2.0-header": f"{MPL_TEXT} (http|https) [www] mozilla org mpl 2 0",
    "cc-by-4.0": f"{_SUBJECT} {_GRANTS} under [a|the] (cc by|creative commons attribution) 4 0 [international] [license]",
    "cc-by-nc-4.0": f"{_SUBJECT} {_GRANTS} under [a|the] (cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial) 4 0 [international] [license]",
    "bsd-2-clause": _bsd(""),
    "bsd-3-clause": _bsd(f"[3|c] neither the name of {{1,12}} nor the names of {{1,3}} contributors {BSD_NAMES}"),
    "isc-text": f"permission to use copy modify and [or] {ISC_TEXT}",
    "zlib-text": ZLIB_TEXT,
    "unlicense": UNLICENSE_TEXT,
}

# Words: runs of 0-9, a-z after lower-casing, and everything outside ASCII.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")


def joined(text: str | None) -> bytes:
    """The words, each between single spaces; a lone space if there are none."""
    found = b" ".join(filter(None, words_of(text)))
    return b" " + found + b" " if found else b" "


# ---- markup ----
# A template's tree: ("word", w), ("any", n, m), ("seq", [...]), ("or", [...]); an optional region is an "or" with an empty "seq".


def parse(markup: str) -> tuple:
    parts = re.findall(r"[\[\]()|]|\{\d+,\d+\}|[^\s\[\]()|{}:]+", markup.lower())
    at = 0

    def choices(end: str) -> tuple:
        nonlocal at
        options, here = [], []
        while at < len(parts) and parts[at] != end:
            part = parts[at]
            at += 1
            if part == "|":
                options.append(("seq", here))
                here = []
            elif part == "[":
                inner = choices("]")
                here.append(("or", [inner, ("seq", [])]))
            elif part == "(":
                here.append(choices(")"))
            elif part in "])":
                raise ValueError(f"{part} closes nothing in {markup}")
            elif part[0] == "{":
                here.append(("any", *map(int, part[1:-1].split(","))))
            else:
                here.append(("word", part))
        if end and at == len(parts):
            raise ValueError(f"{end} is missing in {markup}")
        at += 1
        options.append(("seq", here))
        return options[0] if len(options) == 1 else ("or", options)

    return choices("")


def anchor(tree: tuple) -> bytes:
    """The longest run of words that every match has."""
    runs, here = [], []
    for node in tree[1] if tree[0] == "seq" else []:
        if node[0] == "word":
            here.append(node[1])
        else:
            runs.append(here)
            here = []
    best = max([*runs, here], key=lambda r: len(" ".join(r)))
    return f" {' '.join(best)} ".encode() if best else b" "


def pattern(tree: tuple) -> str:
    """The same language as a regular expression over words that are each followed by a space."""
    kind = tree[0]
    if kind == "word":
        return re.escape(tree[1]) + " "
    if kind == "any":
        return f"(?:[^ ]+ ){{{tree[1]},{tree[2]}}}"
    if kind == "seq":
        return "".join(map(pattern, tree[1]))
    return "(?:" + "|".join(map(pattern, tree[1])) + ")"


@dataclass
class Automaton:
    """States are bits; a set of states is a whole number, and moves between sets are remembered."""

    tree: tuple
    moves: list[tuple[int, bytes | None, int]] = field(default_factory=list)
    empty: dict[int, list[int]] = field(default_factory=dict)
    size: int = 0

    def __post_init__(self) -> None:
        end = self._add(self.tree, self._state())
        self.start, self.accept = self._closure({0}), 1 << end
        self.known: dict[tuple[int, bytes], int] = {}
        by: dict[bytes | None, list[tuple[int, int]]] = {}
        for a, word, b in self.moves:
            by.setdefault(word, []).append((1 << a, self._closure({b})))
        self.by = by

    def _state(self) -> int:
        self.size += 1
        return self.size - 1

    def _move(self, a: int, word: bytes | None) -> int:
        b = self._state()
        self.moves.append((a, word, b))
        return b

    def _add(self, tree: tuple, a: int) -> int:
        kind = tree[0]
        if kind == "word":
            return self._move(a, tree[1].encode())
        if kind == "seq":
            for node in tree[1]:
                a = self._add(node, a)
            return a
        end = self._state()
        if kind == "any":
            for i in range(tree[2] + 1):
                if i >= tree[1]:
                    self.empty.setdefault(a, []).append(end)
                if i < tree[2]:
                    a = self._move(a, None)
        else:
            for option in tree[1]:
                self.empty.setdefault(self._add(option, self._fork(a)), []).append(end)
        return end

    def _fork(self, a: int) -> int:
        b = self._state()
        self.empty.setdefault(a, []).append(b)
        return b

    def _closure(self, states: set[int]) -> int:
        found, new = 0, list(states)
        while new:
            s = new.pop()
            if not found >> s & 1:
                found |= 1 << s
                new += self.empty.get(s, [])
        return found

    def step(self, states: int, word: bytes) -> int:
        if (to := self.known.get((states, word))) is None:
            to = 0
            for a, b in (*self.by.get(word, ()), *self.by.get(None, ())):
                if states & a:
                    to |= b
            if len(self.known) < 100_000:
                self.known[states, word] = to
        return to

    def longest(self, words: list[bytes], at: int) -> int:
        """Where the longest match that starts at a word ends; -1 if none does."""
        states, end = self.start, -1
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if states & self.accept:
                end = i + 1
        return end


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.templates = [(label, anchor(tree := parse(markup)), Automaton(tree)) for label, markup in templates.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
        """The number of words; base phrases as (label, start); matches as (label, start, end), all in words."""
        line = joined(text)
        n = line.count(b" ") - 1
        places, matches = [], []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append((label, at))
                at = line.find(phrase, at + 1)
        if places:  # byte offsets to words, in one sweep
            places.sort(key=lambda p: p[1])
            seen = count = 0
            for i, (label, at) in enumerate(places):
                count += line.count(b" ", seen, at)
                seen = at
                places[i] = (label, count)
        words: list[bytes] | None = None
        for label, needed, automaton in self.templates:
            if needed not in line:
                continue
            if words is None:
                words = line[1:-1].split(b" ")
            at = 0
            while at < len(words):
                end = automaton.longest(words, at) if automaton.step(automaton.start, words[at]) else -1
                if end > at:
                    matches.append((label, at, end))
                at = max(at + 1, end)
        return max(n, 0), places, matches


_SCANNER: list[Scanner] = []


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, base array<struct<label, start>>, matches array<struct<label, start, end>>) of every row."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if templates is not None:
            scanner = Scanner(templates)
        else:
            if not _SCANNER:
                _SCANNER.append(Scanner())
            scanner = _SCANNER[0]
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            base = [[{"label": a, "start": b} for a, b in x] for _, x, _ in found]
            matches = [[{"label": a, "start": b, "end": c} for a, b, c in x] for _, _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(base, base_type), pa.array(matches, match_type)], [id_col, "n_words", "base", "matches"])

    schema = f"`{id_col}` {kind}, n_words long, base array<struct<label:string,start:bigint>>, matches array<struct<label:string,start:bigint,end:bigint>>"
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the contract asks of each scanned row."""
    starts = F.transform("base", lambda x: x["start"])
    names = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda x: x["label"]) for c in columns)))), ",")
    score = F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return scanned.select(id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names("base").alias("base_labels"), names("base", "matches").alias("labels"), score.alias("score"))


def _sql_patterns() -> dict[str, str]:
    """The templates once more, written by hand as regular expressions over words that are each followed by a space."""
    said = lambda text: " ".join(text.split()) + " "
    few = lambda n: rf"(?:[^ ]+ ){{1,{n}}}"
    granted = "(?:this (?:work|software|program|project|code|document|file|package|library) is )?(?:released|licensed|distributed|made available|available|published) under "
    terms = granted + "(?:the terms of )?the "
    later = "(?:or (?:at your option any )?later (?:version )?)?"

    def gnu(name: str) -> str:
        version = f"{name}as published by the free software foundation either version {few(2)}of the license or at your option any later version "
        return f"(?:this program |this library |this file |{few(6)}){said(GNU_FREE)}{version}(?:this program |this library |{few(6)}){said(GNU_HOPE)}{name}for more details "

    def bsd(third: str) -> str:
        first = f"{said(BSD_GRANT)}(?:1 |a )?{said(BSD_SOURCE)}(?:2 |b )?{said(BSD_BINARY)}{third}this software is provided by "
        return f"{first}(?:the copyright holders and contributors |{few(12)}){said(BSD_IMPLIED)}(?:the copyright (?:holder|owner) or contributors |{few(12)}){said(BSD_LIABLE)}"

    return {
        "mit-notice": f"{terms}mit license ",
        "mit-text": f"{said(MIT_GRANT)}{said(MIT_NOTICE)}(?:including the next paragraph )?{said(MIT_KEEP)}{said(MIT_WARRANTY)}",
        "apache-2.0": f"{terms}apache license (?:version )?2 0 ",
        "apache-2.0-header": f"licensed under the apache license version 2 0 {said(APACHE_USE)}https? {said(APACHE_REST)}",
        "gpl-2.0": f"{terms}(?:gnu )?general public license (?:v |version )?2 (?:0 )?{later}",
        "gpl-3.0": f"{terms}(?:gnu )?general public license (?:v |version )?3 (?:0 )?{later}",
        "gpl-header": gnu("general public license "),
        "lgpl-header": gnu("(?:lesser|library) general public license "),
        "agpl-header": gnu("affero general public license "),
        "mpl-2.0-header": f"{said(MPL_TEXT)}https? (?:www )?mozilla org mpl 2 0 ",
        "cc-by-4.0": f"{granted}(?:a |the )?(?:cc by|creative commons attribution) 4 0 ",
        "cc-by-nc-4.0": f"{granted}(?:a |the )?(?:cc by nc|creative commons attribution non ?commercial) 4 0 ",
        "bsd-2-clause": bsd(""),
        "bsd-3-clause": bsd(f"(?:3 |c )?neither the name of {few(12)}nor the names of {few(3)}contributors {said(BSD_NAMES)}"),
        "isc-text": f"permission to use copy modify and (?:or )?{said(ISC_TEXT)}",
        "zlib-text": said(ZLIB_TEXT),
        "unlicense": said(UNLICENSE_TEXT),
    }


def oracle_sql() -> str:
    """The same rows from regular expressions over the joined words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    matched = ",\n         ".join(f"CASE WHEN regexp_matches(line, ' {regex}') THEN '{label}' END" for label, regex in _sql_patterns().items())
    places = []
    for phrase, label in BASE.items():
        tests = " AND ".join(f"w[i{f' + {k}' if k else ''}] = '{x}'" for k, x in enumerate(phrase.split(" ")))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {tests}), lambda i: {{'label': '{label}', 'start': i - 1}})")
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line,
         list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS base FROM t),
m AS (SELECT *, list_filter([{matched}], lambda x: x IS NOT NULL) AS matches, list_transform(base, lambda x: x.label) AS names, list_transform(base, lambda x: x.start) AS starts FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(names, matches))), ','), '') AS labels,
       CAST(CASE WHEN len(matches) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM m
"""
