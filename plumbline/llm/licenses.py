"""License scans by template-markup matching.

A template is license wording with markup: ``<<opt>> ... <<end>>`` encloses an
optional region (they nest), ``<<var N>>`` stands for a replaceable region of 0
to N words, ``<<a|b>>`` for one word out of several. Each template is compiled
into a token automaton; a text is accepted where the automaton's mandatory
wording matches word for word. The first long run of mandatory words anchors
the search, and the automaton runs backwards and forwards from there, so a text
without the anchor costs one substring test per template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import slices, texts, word_table

#: Phrases whose places are always reported. Fixed values.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_AS_IS = "the software is provided as is without warranty of any kind"
#: License wording with markup, by label. Fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "<<opt>>the mit license<<end>> <<opt>>copyright <<opt>>c<<end>> <<var 12>><<end>> permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software " + _AS_IS + " express or implied"),
    ("mit", "<<opt>><<released|licensed|distributed|available>><<end>> under the <<opt>>terms of the<<end>> mit license"),
    ("apache-2", "licensed under the apache license version 2 <<opt>>0<<end>> <<opt>>the license you may not use this file except in compliance with the license <<opt>>you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license<<end>><<end>>"),
    ("apache-2", "licensed under the <<opt>>terms of the<<end>> apache <<opt>>software<<end>> license <<opt>>version<<end>> 2 <<opt>>0<<end>>"),
    ("gpl-3", "under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation either<<end>> version 3 <<opt>>of the license<<end>> <<opt>>or <<opt>>at your option<<end>> any later version<<end>>"),
    ("gpl-2", "under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation either<<end>> version 2 <<opt>>of the license<<end>> <<opt>>or <<opt>>at your option<<end>> any later version<<end>>"),
    ("lgpl", "under the <<opt>>terms of the<<end>> gnu <<lesser|library>> general public license <<opt>>as published by the free software foundation either<<end>> <<opt>>version <<2|3>> <<opt>>1<<end>><<end>>"),
    ("agpl-3", "under the <<opt>>terms of the<<end>> gnu affero general public license <<opt>>as published by the free software foundation either<<end>> <<opt>>version 3<<end>>"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0 <<opt>>if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http<<end>> <<opt>>https<<end>> mozilla org mpl 2 0<<end>>"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<<end>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies <<opt>>the software is provided as is and <<var 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness<<end>>"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("unlicense", "this is free and unencumbered software released into the public domain <<opt>>anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means<<end>>"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed <<var 16>> you just do what the fuck you want to"),
    ("gpl-3", "<<opt>>this program is free software you can redistribute it and or modify it<<end>> under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version <<opt>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details<<end>>"),
    ("gpl-2", "<<opt>>this program is free software you can redistribute it and or modify it<<end>> under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version <<opt>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details<<end>>"),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc <<var 3>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc <<var 16>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("apache-2", "apache license version 2 0 january 2004 <<opt>>http www apache org licenses<<end>> terms and conditions for use reproduction and distribution"),
    ("mpl-2", "mozilla public license version 2 0 1 definitions"),
    ("epl-2", "under the terms of the eclipse public license <<opt>>v<<end>> <<opt>>version<<end>> 2 0"),
    ("cc-by-nc", "<<licensed|released|available|distributed>> under <<opt>>a<<end>> <<opt>>the<<end>> cc by nc <<opt>><<sa|nd>><<end>> <<opt>><<1|2|3|4>> <<0|5>><<end>>"),
    ("cc-by-nc", "creative commons attribution noncommercial <<opt>><<sharealike|noderivatives|noderivs>><<end>> <<opt>><<1|2|3|4>> <<0|5>><<end>> <<opt>><<var 2>> license<<end>>"),
    ("cc-by-sa", "<<licensed|released|available|distributed>> under <<opt>>a<<end>> <<opt>>the<<end>> cc by sa <<opt>><<1|2|3|4>> <<0|5>><<end>>"),
    ("cc-by-sa", "creative commons attribution sharealike <<opt>><<1|2|3|4>> <<0|5>><<end>> <<opt>><<var 2>> license<<end>>"),
    ("cc-by", "<<licensed|released|available|distributed>> under <<opt>>a<<end>> <<opt>>the<<end>> cc by <<1|2|3|4>> <<0|5>>"),
    ("cc0", "to the extent possible under law <<var 12>> has waived all copyright and related or neighboring rights <<opt>>to <<var 12>><<end>>"),
    ("cc0", "<<licensed|released|available|distributed>> under <<opt>>a<<end>> <<opt>>the<<end>> cc0 <<opt>>1 0<<end>> <<opt>>license<<end>>"),
]

_WORDS = word_table()


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case: runs of digits, letters a-z and non-ASCII characters."""
    return text.translate(_WORDS).split()


class Automaton:
    """A token automaton of one template: a list of (kind, value) steps, and for optional regions the step behind them.

    Steps are ``("word", {alternatives})``, ``("skip", target)`` (go on, or jump
    to target) and ``("any", n)`` (0 to n words).
    """

    def __init__(self, label: str, template: str):
        self.label = label
        tree, stack = [], []
        for part in re.findall(rb"<<[^>]*>>|[^\s<>]+", template.encode()):
            if part == b"<<opt>>":
                stack.append(tree)
                tree = []
            elif part == b"<<end>>":
                inner, tree = tree, stack.pop()
                tree.append(("opt", inner))
            elif part.startswith(b"<<var "):
                tree.append(("any", int(part[6:-2])))
            elif part.startswith(b"<<"):
                tree.append(("word", frozenset(part[2:-2].split(b"|"))))
            else:
                tree.append(("word", frozenset([part])))
        if stack:
            raise ValueError(f"an optional region of {label} has no end")
        runs, i = [], 0
        while i < len(tree):
            j = i
            while j < len(tree) and tree[j][0] == "word" and len(tree[j][1]) == 1:
                j += 1
            if j > i:
                runs.append((j - i, -i))
            i = max(j, i + 1)
        if not runs:
            raise ValueError(f"{label} has no mandatory wording")
        length, at = max((min(n, 4), start) for n, start in runs)
        at = -at
        self.anchor = b" " + b" ".join(next(iter(w)) for _, w in tree[at : at + length]) + b" "
        self.length = length
        self.forward = self._steps(tree[at + length :])
        self.backward = self._steps(self._reversed(tree[:at]))
        self.ahead, self.behind = self._first(self.forward), self._first(self.backward)

    @classmethod
    def _reversed(cls, tree: list) -> list:
        return [(k, cls._reversed(v)) if k == "opt" else (k, v) for k, v in reversed(tree)]

    @classmethod
    def _steps(cls, tree: list, base: int = 0) -> list[tuple[str, object]]:
        steps: list[tuple[str, object]] = []
        for kind, value in tree:
            if kind == "opt":
                inner = cls._steps(value, base + len(steps) + 1)
                steps.append(("skip", base + len(steps) + 1 + len(inner)))
                steps += inner
            else:
                steps.append((kind, value))
        return steps

    @staticmethod
    def _first(steps: list[tuple[str, object]]) -> frozenset[bytes] | None:
        """The words with which an accepted run has to begin; None if it may be empty or begin with any word."""
        open_, seen, words = [0], set(), set()
        while open_:
            k = open_.pop()
            if k in seen:
                continue
            seen.add(k)
            if k == len(steps) or steps[k][0] == "any":
                return None
            if steps[k][0] == "skip":
                open_ += [k + 1, steps[k][1]]
            else:
                words |= steps[k][1]
        return frozenset(words)

    @staticmethod
    def _run(steps: list[tuple[str, object]], words: list[bytes], at: int, step: int) -> int | None:
        """How many words the longest accepted run takes from ``at`` on in direction ``step``; None if it isn't accepted."""
        best, states, taken = None, {(0, 0)}, 0
        while states:
            open_, closed = list(states), set()
            while open_:
                state = open_.pop()
                if state in closed:
                    continue
                closed.add(state)
                k, used = state
                if k == len(steps):
                    best = taken
                elif steps[k][0] == "skip":
                    open_ += [(k + 1, 0), (steps[k][1], 0)]
                elif steps[k][0] == "any":
                    open_.append((k + 1, 0))
            if not 0 <= at < len(words):
                break
            word, states = words[at], set()
            for k, used in closed:
                if k < len(steps) and steps[k][0] == "word" and word in steps[k][1]:
                    states.add((k + 1, 0))
                elif k < len(steps) and steps[k][0] == "any" and used < steps[k][1]:
                    states.add((k, used + 1))
            at += step
            taken += 1
        return best

    def matches(self, words: list[bytes], joined: bytes) -> Iterator[tuple[int, int]]:
        """(first word, word behind the last) of each accepted place. ``joined``: the words with one space around each."""
        for start in _starts(joined, self.anchor):
            end = start + self.length
            if self.behind is not None and (not start or words[start - 1] not in self.behind) or self.ahead is not None and (end >= len(words) or words[end] not in self.ahead):
                continue
            ahead = self._run(self.forward, words, end, 1)
            if ahead is not None:
                behind = self._run(self.backward, words, start - 1, -1)
                if behind is not None:
                    yield start - behind, end + ahead


def _starts(joined: bytes, sought: bytes) -> Iterator[int]:
    """The word numbers at which ``sought`` (with a space around it) stands in ``joined``, counted in one pass."""
    at, last, n = joined.find(sought), 0, 0
    while at >= 0:
        n += joined.count(b" ", last, at)
        last = at
        yield n
        at = joined.find(sought, at + 1)


def outermost(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans by place, without those inside a longer one: of the templates that accept a place, the one of most words stands for it."""
    kept: list[tuple[str, int, int]] = []
    end = -1
    for x in sorted(set(spans), key=lambda x: (x[1], -x[2], x[0])):
        if x[2] > end or kept and kept[-1][1:] == x[1:]:
            kept.append(x)
            end = max(end, x[2])
    return kept


def scan_text(text: bytes, automata: list[Automaton], phrases: dict[str, str]) -> tuple[int, dict[str, np.ndarray], list[tuple[str, int, int]]]:
    """(number of words, {phrase: starts of its places}, [(label, start, end)] of the templates' places, by place)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places = {p: np.fromiter(_starts(joined, b" " + p.encode() + b" "), np.int64) for p in phrases}
    return len(words), places, outermost([(a.label, s, e) for a in automata for s, e in a.matches(words, joined)])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long>>"
#: A template's span of so many words is a license's wording in full measure.
FULL_WORDS = 40


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, base phrase places, labels and accepted template spans.

    A null text counts as empty; a null doc_id stays null; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows.
    Of spans inside one another only the longest is given, so wording that one
    license shares with a longer one counts for the longer one. ``score`` says
    how much of the license stands there: 0.5 where only a base phrase does,
    else 0.5 and half the words of the longest span per 40, 1 at most; 0 without
    either. Map-only: no shuffle, memory bounded by one slice of texts, time
    linear in their length.
    """
    automata = [Automaton(*x) for x in (TEMPLATES if templates is None else templates)]
    phrases = BASE_PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out, offsets, found = [], [0], []
            for text in texts(batch, "text"):
                n, places, spans = scan_text(text, automata, phrases)
                starts = [x for x in places.values() if len(x)]
                base = {phrases[p] for p, x in places.items() if len(x)}
                longest = max((e - s for _, s, e in spans), default=0)
                score = 0.5 + 0.5 * min(1.0, longest / FULL_WORDS) if base or spans else 0.0
                first, last = (min(int(x[0]) for x in starts), max(int(x[-1]) for x in starts)) if starts else (None, None)
                out.append((n, sum(map(len, starts)), first, last, ",".join(sorted(base)), ",".join(sorted(base | {label for label, _, _ in spans})), score))
                found += spans
                offsets.append(len(found))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            parts = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["label", "first_word", "end_word"]))
            names = [x.split()[0] for x in SCHEMA.split(", ")[:8]] + ["spans"]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns, spans], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
