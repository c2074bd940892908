"""License scan: base phrases, and templates with optional and replaceable regions.

A template is text with ``<<beginOptional>> .. <<endOptional>>`` around regions that may
be missing and ``<<var>>`` where any number of words of any kind may stand. Compiled, it is
an automaton over words; a place in a text is accepted if its words, with optional regions
present or not and replaceable ones filled, are the mandatory wording exactly. A replaceable
region is a state that loops on every word, so a text of any length goes on from the
earliest place at which that state was reached: the automaton falls into the parts between
its loops, and each part is looked for behind the earliest end of the one before.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, pieces

#: The base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Licenses and notices in template markup, by label. The whole wording outside
#: the regions is mandatory; -opening labels are only the first clause of a license.
TEMPLATES = {
    "mit": "<<beginOptional>>this software is <<endOptional>>released under the <<beginOptional>>terms of the <<endOptional>>MIT License",
    "mit-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        <<beginOptional>>1.<<endOptional>> The above copyright notice and this permission notice <<beginOptional>>(including the
        next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        <<beginOptional>>2.<<endOptional>> THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
        <<var>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var>> BE LIABLE FOR
        ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>>
        Neither the name of <<var>> nor the names of <<beginOptional>>its<<endOptional>><<beginOptional>>their<<endOptional>>
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY <<var>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL <<var>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
        <<beginOptional>>author<<endOptional>><<beginOptional>>authors<<endOptional>> be held liable for any damages arising from the use of this software. Permission
        is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
        in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any
        source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "apache-2.0": "licensed under the Apache License<<beginOptional>>, version <<endOptional>> 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var>> except
        in compliance with the License. You may obtain a copy of the License at <<beginOptional>>https<<endOptional>>
        <<beginOptional>>http<<endOptional>> <<beginOptional>>www.<<endOptional>>apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License <<beginOptional>>version <<endOptional>><<beginOptional>>v <<endOptional>>3",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License <<beginOptional>>version <<endOptional>><<beginOptional>>v <<endOptional>>2",
    "gpl-3.0-notice": """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. <<var>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-SA 4.0",
    "cc-by-4.0": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY 4.0",
    "copyright-notice": "copyright <<beginOptional>>(c) <<endOptional>><<var>> all rights reserved",
}

#: Bytes of a text that are taken apart at a time.
CHUNK = 1 << 18

#: Bytes that are no part of a word become spaces; A-Z become a-z.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _parts(markup: str) -> list[str]:
    """Marks of regions, and the words between them as texts have theirs."""
    out: list[str] = []
    for part in re.findall(r"<<.*?>>|[^<]+", markup):
        out += [part] if part.startswith("<<") else [w.decode() for w in part.encode().translate(_TABLE).split()]
    return out


def compile_part(parts: list[str]) -> tuple[list, int]:
    """Arcs of each state and the accepting state of words and optional regions.

    An arc is (word, next); "" is a step that takes no word.
    """
    arcs: list[list[tuple[str, int]]] = [[]]
    opened: list[int] = []
    for part in parts:
        at = len(arcs) - 1
        if part == "<<beginOptional>>":
            opened.append(at)
        elif part == "<<endOptional>>":
            if not opened:
                raise ValueError("an optional region ends that has not begun")
            arcs.append([])
            arcs[at].append(("", at + 1))
            arcs[opened.pop()].append(("", at + 1))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup: {part}")
        else:
            arcs.append([])
            arcs[at].append((part, at + 1))
    if opened:
        raise ValueError("an optional region is not ended, or holds a replaceable one")
    return arcs, len(arcs) - 1


class Automaton:
    """A part of a template between its loops; states are closed over steps that take no word."""

    def __init__(self, parts: list[str]):
        arcs, self.final = compile_part(parts)

        def closed(state: int) -> frozenset[int]:
            found, todo = {state}, [state]
            while todo:
                for word, to in arcs[todo.pop()]:
                    if word == "" and to not in found:
                        found.add(to)
                        todo.append(to)
            return frozenset(found)

        self.closed = [closed(s) for s in range(len(arcs))]
        self.arcs = [[(w.encode(), to) for w, to in a if w != ""] for a in arcs]
        self.begins = {w for s in self.closed[0] for w, _ in self.arcs[s]}
        if self.final in self.closed[0]:
            raise ValueError("no mandatory word stands at an end of a template or between two replaceable regions")
        # a word that each text accepted must hold: one without it isn't searched further
        self.rarest = b" " + max(mandatory(parts), key=len) + b" "

    def end_from(self, words: list[bytes], start: int) -> int | None:
        """The earliest end of what is accepted from ``start`` on."""
        states = self.closed[0]
        for i in range(start, len(words)):
            nxt = {c for s in states for w, to in self.arcs[s] if w == words[i] for c in self.closed[to]}
            if self.final in nxt:
                return i + 1
            if not nxt:
                return None
            states = nxt
        return None

    def earliest_end(self, words: list[bytes], start: int, starts: int) -> int | None:
        """The earliest end of what is accepted and begins at ``start`` .. ``starts``; what begins
        later but ends before counts as well."""
        best, i = None, start
        while i < (starts if best is None else best):
            if words[i] in self.begins and (end := self.end_from(words, i)) is not None:
                best = end if best is None else min(best, end)
            i += 1
        return best


def mandatory(parts: list[str]) -> list[bytes]:
    """The words outside any optional region."""
    text, depth = [], 0
    for part in parts:
        depth += (part == "<<beginOptional>>") - (part == "<<endOptional>>")
        if not part.startswith("<<") and not depth:
            text.append(part.encode())
    return text


def compile_template(markup: str) -> list[Automaton]:
    """The automata of a template's parts, one more than it has replaceable regions."""
    parts: list[list[str]] = [[]]
    for part in _parts(markup):
        if part == "<<var>>":
            parts.append([])
        else:
            parts[-1].append(part)
    return [Automaton(p) for p in parts]


@lru_cache(maxsize=4)
def _compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[Automaton]]]:
    return [(label, compile_template(markup)) for label, markup in templates]


def _places(line: bytes, phrase: bytes):
    """At which words of a line a phrase's words stand; places may overlap."""
    word, last, at = 0, 0, line.find(phrase)
    while at >= 0:
        word += line.count(b" ", last, at)
        yield word
        last, at = at, line.find(phrase, at + 1)


def _stretches(raw: bytes, reach: int):
    """(words, starts) of a text's words bit by bit: ``starts`` new words, and up to
    ``reach`` more that what begins in them may go on into."""
    parts = pieces(raw, CHUNK)
    words = next(parts, b"").split()
    more = True
    while more:
        ahead: list[bytes] = []
        while len(ahead) < reach and (part := next(parts, None)) is not None:
            ahead += part.split()
        more = bool(ahead)
        yield words + ahead[:reach], len(words)
        words = ahead


def scan_text(text: str | None, phrases: dict[str, str], templates: tuple) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    compiled = _compiled(templates)
    reach = max([len(part.arcs) for _, parts in compiled for part in parts] + [len(p.split()) for p in phrases], default=1)
    total, n, first, last = 0, 0, None, None
    base: set[str] = set()
    reached = [(0, 0)] * len(compiled)  # parts of each template found, and where the next may begin
    for words, starts in _stretches((text or "").encode().translate(_TABLE), reach):
        line = b" " + b" ".join(words) + b" "
        for phrase, label in phrases.items():
            for word in _places(line, b" " + phrase.encode() + b" "):
                if word >= starts:
                    break
                n, base, word = n + 1, base | {label}, word + total
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
        for n_template, (_, parts) in enumerate(compiled):
            part, at = reached[n_template]
            while part < len(parts) and parts[part].rarest in line and (end := parts[part].earliest_end(words, at, starts)) is not None:
                part, at = part + 1, end
            reached[n_template] = part, max(at - starts, 0)
        total += starts
    own = {label for (label, parts), (part, _) in zip(compiled, reached) if part == len(parts)}
    score = 1.0 if own else 0.5 if base else 0.0
    return total, n, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), score


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and what ``scan_text`` finds in each row's whole text.

    Score is 1 where a template is accepted, 0.5 where only base phrases stand, else 0.
    A null or empty text has no words, null places, empty labels and score 0; a very long
    one is scanned whole, bit by bit. Row-wise: repeated rows and hot sources don't matter.
    Other columns are not read, and an empty table gives an empty result.
    """
    compiled = tuple(templates.items())

    def make(batch: pa.RecordBatch):
        rows = [scan_text(t, phrases, compiled) for t in batch.column("text").to_pylist()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    fields = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    return add_columns(docs.select("doc_id", "text"), fields, make, without=("text",))
