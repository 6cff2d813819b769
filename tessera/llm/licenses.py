"""License scans by template markup.

A template is the license's wording with regions in double angle brackets:

* ``<<optional>> ... <</optional>>``  words that may be missing (regions may nest)
* ``<<var N>>`` up to N words of any kind (names, years)
* ``<<one a|b|c>>`` exactly one of the listed words or word groups

Each template becomes a token automaton (states between words, with empty moves around
optional regions). A text matches where the mandatory words follow each other exactly, from
the template's first word to its last; one word that is changed, missing or added outside the regions, and the text isn't
that license. Automata run only where a template's first words stand, which a C-speed search in the normalised text finds.

Base phrases are searched as they stand. score is the share of a text's words that stand in
a phrase or a matched template. Null or empty text: no words, empty labels, score 0, null
places. Repeated rows are judged one by one; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, map_arrow

#: Fixed values of the base scan: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license wordings (fixed values): conditions, clauses and disclaimers with what may be left out or replaced. Labels are
#: SPDX identifiers where one exists; the -grant, -notice and -version templates are wordings that stand alone in practice.
TEMPLATES = {
    "mit": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions
        the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies
        or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall <<one the|the above>> <<var 6>>
        <<one authors or copyright holders|copyright holders|authors>> be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "mit-grant": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction""",
    "bsd-2-clause": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution
        this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
        data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
        negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "bsd-3-clause": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution
        <<optional>>3<</optional>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission
        this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
        data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
        negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "bsd-grant": """redistribution and use in source and binary forms with or without modification are permitted""",
    "isc": """
        permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<one the author|isc>> disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall <<one the author|isc>> be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software""",
    "isc-grant": """
        permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted""",
    "apache-2.0": """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy
        of the license at <<one http|https>> www apache org licenses license 2 0 <<optional>>txt<</optional>>
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
        under the license""",
    "apache-notice": """licensed under the apache license version 2 0""",
    "mpl-2.0": """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at <<one http|https>> mozilla org mpl 2 0""",
    "gpl-or-later": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version <<one 2|3>> of the license or at your option any later version
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
        or fitness for a particular purpose see the gnu general public license for more details""",
    "lgpl-or-later": """
        this <<one library|program>> is free software you can redistribute it and or modify it under the terms of the gnu <<one lesser|library>> general
        public license as published by the free software foundation either version <<one 2|2 1|3>> of the license or at your option any later version
        this <<one library|program>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu <<one lesser|library>> general public license for more details""",
    "gpl-notice": """
        under the terms of the gnu <<one general|lesser general|library general|affero general>> public license
        <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version <<one 1|2|3|2 1>>""",
    "gpl-version": """
        gnu general public license <<optional>>as published by the free software foundation either<</optional>> <<one version|v>> <<one 1|2|3>>""",
    "unlicense-notice": """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    "zlib": """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
        from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
        alter it and redistribute it freely subject to the following restrictions
        <<optional>>1<</optional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use
        this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        <<optional>>2<</optional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<optional>>3<</optional>> this notice may not be removed or altered from any source distribution""",
    "cc-notice": """
        this work is licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution
        <<optional>><<one noncommercial|sharealike|noderivatives|noderivs|noncommercial sharealike|noncommercial noderivatives|noncommercial noderivs>><</optional>>
        <<one 1 0|2 0|2 5|3 0|4 0>> <<one international|generic|unported|united states>> license""",
    "cc-by-family": """
        licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> <<one cc|creative commons>> <<one by|attribution>>
        <<optional>><<one nc|sa|nd|noncommercial|sharealike|noderivatives|noderivs>><</optional>>
        <<optional>><<one nc|sa|nd|noncommercial|sharealike|noderivatives|noderivs>><</optional>> <<one 1 0|2 0|2 5|3 0|4 0>>""",
    "copyright-notice": """copyright <<optional>>c<</optional>> <<var 8>> all rights reserved""",
}

_MARK = re.compile(r"<<(/?optional|var \d+|one [^>]*)>>")


class Automaton:
    """States are numbers; `words[s]` leads on by a word, `free[s]` by any word, `empty[s]` by none."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.empty: list[set[int]] = [set()]
        at, opened, lead = 0, [], []
        for k, part in enumerate(_MARK.split(template)):
            if k % 2 == 0:
                for word in alnum_words(part.encode()):
                    at = self._step(at, word)
                    if lead is not None:
                        lead.append(word)
                continue
            kind, _, rest = part.partition(" ")
            if lead is not None:
                self.lead, lead = lead, None
            if kind == "optional":
                opened.append(at)
            elif kind == "/optional":
                self.empty[opened.pop()].add(at)
            elif kind == "var":
                begin = at
                stops = [begin]
                for _ in range(int(rest)):
                    nxt = self._state()
                    self.free[stops[-1]].add(nxt)
                    stops.append(nxt)
                at = self._state()
                for s in stops:
                    self.empty[s].add(at)
            else:
                end = self._state()
                for choice in rest.split("|"):
                    s = at
                    for word in alnum_words(choice.encode()):
                        s = self._step(s, word)
                    self.empty[s].add(end)
                at = end
        if lead is not None:
            self.lead = lead
        if not self.lead:
            raise ValueError("a template begins with mandatory words")
        self.last = at

    def _state(self) -> int:
        for table, new in ((self.words, {}), (self.free, set()), (self.empty, set())):
            table.append(new)
        return len(self.words) - 1

    def _step(self, at: int, word: bytes) -> int:
        nxt = self._state()
        self.words[at].setdefault(word, set()).add(nxt)
        return nxt

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def match(self, words: list[bytes], first: int) -> int | None:
        """End (exclusive) of the longest match that begins at word `first`, or None."""
        states, end = self._closed({0}), None
        for at in range(first, len(words)):
            states = self._closed({t for s in states for t in (self.words[s].get(words[at], set()) | self.free[s])})
            if not states:
                break
            if self.last in states:
                end = at + 1
        return end


_COMPILED: dict[tuple, list] = {}


def compiled(templates: dict[str, str]) -> list[tuple[str, Automaton, bytes]]:
    key = tuple(sorted(templates.items()))
    if key not in _COMPILED:
        _COMPILED[key] = [(label, a := Automaton(t), b" " + b" ".join(a.lead) + b" ") for label, t in key]
    return _COMPILED[key]


def places(text: bytes, phrase: bytes) -> list[int]:
    """Offsets of every occurrence; `phrase` has a space at either end, and neighbours may share one."""
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


_PHRASES = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in PHRASES.items()]


def scan(words: list[bytes], templates: list[tuple[str, Automaton, bytes]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Word intervals [first, end) with their labels: of base phrases, and of templates."""
    base, more = [], []
    text = b" " + b" ".join(words) + b" "
    found = [(at, n, label) for phrase, n, label in _PHRASES for at in places(text, phrase)]
    leads = [(at, automaton, label) for label, automaton, lead in templates for at in places(text, lead)]
    if found or leads:
        starts = np.flatnonzero(np.frombuffer(text, "u1") == 32).tolist()  # the space before word k
        number = lambda at: bisect_right(starts, at) - 1
        base = [(number(at), number(at) + n, label) for at, n, label in found]
        for at, automaton, label in leads:
            if (end := automaton.match(words, number(at))) is not None:
                more.append((number(at), end, label))
    return base, more


def covered(spans: list[tuple[int, int, str]]) -> int:
    n = upto = 0
    for a, b, _ in sorted(spans):
        n += max(0, b - max(a, upto))
        upto = max(upto, b)
    return n


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document row: the columns of the digest, and spans (label:first word:end word of every match)."""
    templates = TEMPLATES if templates is None else templates

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        automata, rows = compiled(templates), []
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words = alnum_words(text)
            base, more = scan(words, automata)
            firsts, every = [a for a, _, _ in base], sorted(base + more)
            rows.append(
                (doc_id, len(words), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in every})), covered(every) / len(words) if words else 0.0, ",".join(f"{label}:{a}:{b}" for a, b, label in every))
            )
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _OUT.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, _OUT)
