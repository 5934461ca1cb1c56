"""License scans: a generalised suffix automaton over license tokens, streamed matching statistics, chained spans."""

from __future__ import annotations

import re
from bisect import insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, texts_of

#: Phrases and their labels as the query's contract has them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The notices by which licenses say they apply, from the public license texts.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. Released under the MIT License.",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "boost": "Distributed under the Boost Software License, Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Further texts of a label, each a template of its own: versions, relatives, and the way a license is named in a line.
FURTHER = {
    "gpl-2": [
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License version 2",
    ],
    "gpl-3": ["GNU General Public License as published by the Free Software Foundation; either version 3 of the License", "Licensed under the GNU General Public License version 3"],
    "lgpl-2": ["GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", "Licensed under the GNU Library General Public License version 2"],
    "lgpl-2.1": [
        "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License version 2.1",
    ],
    "lgpl-3": [
        "GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License version 3",
    ],
    "agpl-3": [
        "GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License version 3",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "cc-by": ["Licensed under a Creative Commons Attribution License", "Licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0"],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0"],
    "cc-by-nc-sa": ["This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0"],
    "cc-by-nc-nd": ["This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0"],
}

#: Words that tell relatives of a family apart, in the form that they are held against each other.
KINDS = {b"lesser": "lesser", b"library": "library", b"affero": "affero"}
TERMS = {b"attribution": "by", b"noncommercial": "nc", b"sharealike": "sa", b"noderivatives": "nd", b"noderivs": "nd", b"by": "by", b"nc": "nc", b"sa": "sa", b"nd": "nd"}

_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and bytes above 0x7F."""
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over token ids; each state keeps where one of its strings ends."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self.clone(last, token, q)
        new, p = self.state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.clone(p, token, q)
        return new

    def clone(self, p: int, token: int, q: int) -> int:
        c = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, tokens: list[int], template: int) -> None:
        last = 0
        for i, t in enumerate(tokens):
            last = self.extend(last, t)
            self.ends[last].add((template, i + 1))

    def close(self) -> None:
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def maximal(self, tokens: list[int], shortest: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of matches that can't go on to the right, `shortest` tokens or longer."""
        out, s, n = [], 0, 0
        for i, t in enumerate(tokens):
            if (to := self.next[s].get(t)) is not None:
                s, n = to, n + 1
                continue
            if n >= shortest:
                out.append((i - n, n, s))
            while s >= 0 and t not in self.next[s]:
                s = self.link[s]
            s, n = (0, 0) if s < 0 else (self.next[s][t], self.length[s] + 1)
        if n >= shortest:
            out.append((len(tokens) - n, n, s))
        return out


def version_of(words: list[bytes]) -> str | None:
    """The first version that is named: after `version`, `v` or a license's name; 2 and 2.0 are one."""
    for i, w in enumerate(words):
        if w.startswith(b"v") and w[1:].isdigit():
            major, rest = w[1:], words[i + 1 : i + 2]
        elif w in (b"version", b"v", b"license", b"gpl", b"lgpl", b"agpl") and i + 1 < len(words) and words[i + 1].removeprefix(b"v").isdigit():
            major, rest = words[i + 1].removeprefix(b"v"), words[i + 2 : i + 3]
        else:
            continue
        if len(major) < 3:
            minor = rest[0].decode() if rest and rest[0].isdigit() and len(rest[0]) == 1 else "0"
            return major.decode() if minor == "0" else f"{major.decode()}.{minor}"
    return None


def traits(words: list[bytes], first: int, past: int) -> tuple[str, frozenset[str], str | None]:
    """(family, kind, version) of the words [first, past) and those close by: `gpl` for the GNU licenses, `cc` for Creative Commons, else ''.

    A kind before a license's name counts, and what comes shortly after; of several versions the first one behind."""
    own = words[first:past]
    version = version_of(words[first : past + 8])
    if b"public" in own and b"general" in own:
        return "gpl", frozenset(KINDS[w] for w in words[max(0, first - 3) : past] if w in KINDS), version
    near = words[first : past + 3]
    if b"creative" in own or b"cc" in own:
        at = next(i for i, w in enumerate(near) if w in (b"creative", b"cc"))
        chain, i = set(), at + 1
        while i < len(near) and (near[i] in TERMS or near[i] in (b"commons", b"non", b"commercial", b"share", b"alike", b"no")):
            pair = b"".join(near[i : i + 2])
            if near[i] in TERMS or pair in TERMS:
                chain.add(TERMS.get(near[i]) or TERMS[pair])
            i += 1
        return "cc", frozenset(chain), None
    return "", frozenset(), version


class Scanner:
    def __init__(self, templates: dict[str, str], shortest: int = 4, gap: int = 6, covered: float = 0.5, least: int = 5, further: dict[str, list[str]] | None = None):
        """Matches of `shortest` tokens or more chain where both gaps are at most `gap` tokens: each goes on the newest chain that it can. A chain
        labels a text if it covers `covered` of the template or `least` tokens with a word that only templates of its label have, or `least` tokens of a family whose kind and version stand there, and if the words around it don't
        contradict the template (another version, another kind of its family). See unrivalled() for chains of several labels over the same words."""
        texts = [*templates.items(), *((k, t) for k, more in (further or {}).items() for t in more)]
        self.names = [k for k, _ in texts]
        tokens = [words_of(t.encode()) for _, t in texts]
        self.traits = [traits(t, 0, len(t)) for t in tokens]
        self.sizes = [len(t) for t in tokens]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.coded = [[self.ids[w] for w in t] for t in tokens]
        labels: dict[int, set[str]] = {}
        for name, t in zip(self.names, self.coded, strict=True):
            for x in t:
                labels.setdefault(x, set()).add(name)
        self.own = [{x for x in t if len(labels[x]) == 1} for t in self.coded]
        self.shortest, self.gap, self.covered, self.least = shortest, gap, covered, least
        self.sam = Automaton()
        for k, t in enumerate(self.coded):
            self.sam.add(t, k)
        self.sam.close()

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, one past the last word, tokens covered, share of the template covered) of the chains that count."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(known[::2], known[1::2], strict=True):
            if b - a >= self.shortest:
                for start, n, state in self.sam.maximal(ids[a:b].tolist(), self.shortest):
                    for k, end in self.sam.ends[state]:
                        found.setdefault(k, []).append((int(a) + start, end - n, n))
        out = []
        for k, matches in found.items():
            chains: list[list[int]] = []  # start, end in text, end in template, covered, own words
            open_: dict[tuple[int, int], list[int]] = {}  # chains by both ends, the newest last
            for at, of, n in sorted(set(matches)):
                own = len(self.own[k] & set(self.coded[k][of : of + n]))
                near = [(x, y) for x in range(at - self.gap, at + 1) for y in range(of - self.gap, of + 1) if (x, y) in open_]
                if near:
                    ends = max(near, key=lambda e: open_[e][-1])
                    i = open_[ends].pop()
                    if not open_[ends]:
                        del open_[ends]
                    c = chains[i]
                    c[1], c[2], c[3], c[4] = at + n, of + n, c[3] + n, c[4] + own
                else:
                    i = len(chains)
                    chains.append([at, at + n, of + n, n, own])
                insort(open_.setdefault((at + n, of + n), []), i)
            out += [(self.names[k], c[0], c[1], c[3], c[3] / self.sizes[k]) for c in chains if (c[3] >= self.covered * self.sizes[k] or c[3] >= self.least and (c[4] or self.traits[k][0])) and self.agrees(k, words, c[0], c[1])]
        return sorted(out, key=lambda x: (x[1], -x[3], x[0]))

    def agrees(self, k: int, words: list[bytes], first: int, past: int) -> bool:
        """Whether the words around a chain are of the template's kind and version; a license of a family must say its own, others may leave it out."""
        family, kind, version = self.traits[k]
        if not family and version is None:
            return True
        family_there, kind_there, version_there = traits(words, first, past)
        if family:
            return family_there == family and kind_there == kind and version_there == version
        return version_there is None or version_there == version

    def phrases(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place where the words of a phrase stand one after another."""
        out = []
        there = None
        for phrase, label in PHRASES.items():
            p = phrase.encode().split()
            if there is None:
                there = set(words)
            if there.issuperset(p):
                out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i : i + len(p)] == p]
        return sorted(out)


def unrivalled(spans: list[tuple]) -> list[tuple]:
    """Spans but for those within whose words a span of another label covers more: of the words a text shares with several licenses, the longest match has them."""
    beaten = set()
    live: list[tuple] = []
    for x in sorted(spans, key=lambda x: (x[1], -x[2])):
        live = [y for y in live if y[2] > x[1]]
        for y in live:
            if x[0] != y[0]:
                small, big = sorted((x, y), key=lambda z: z[3])
                if small[3] < big[3] and big[1] <= small[1] and small[2] <= big[2]:
                    beaten.add(small)
        live.append(x)
    return [x for x in spans if x not in beaten]


TYPE = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,past:long,tokens:long,share:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, further: dict[str, list[str]] = FURTHER) -> DataFrame:
    """One row for each row of docs, in one pass without a shuffle: phrase places, labels and template spans of the whole text.

    Null text counts as empty: no words, no labels, score 0. score: the largest share of a template that a chain covers, at least 0.5 where
    a base phrase stands. Overlapping spans of several templates all stay. doc_id keeps the type of `id_col`; repeated rows come back each."""

    def run(batches):
        scanner = Scanner(templates, further=further)
        for b in batches:
            rows = []
            for t in texts_of(b.column(1)):
                words = words_of(t)
                base, spans = scanner.phrases(words), unrivalled(scanner.spans(words))
                own = {label for _, label in base}
                score = max([0.5 if base else 0.0, *(min(1.0, s[4]) for s in spans)])
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score, [dict(zip(("label", "first", "past", "tokens", "share"), s, strict=True)) for s in spans]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("tokens", pa.int64()), ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *re.findall(r"(\w+) (?:long|string|double|array)", TYPE)])

    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)[id_col]}, {TYPE}")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of all `documents`."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
