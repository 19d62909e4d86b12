"""Licence scans: units of text compared to licence templates by the Dice coefficient of their word bigrams.

The units of a document are its sentences, lines, blocks between blank lines, the whole, and its dense spans: runs of words
in which bigrams known to some template follow each other closely. Spans go over line ends, comment marks and blank lines,
and leave out what stands around a text, such as copyright lines. Bigrams
of all texts of a batch are hashed at once; a unit is compared only to templates that its size and
the number of its bigrams known to any template allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import textvec
from siteloom.llm.common import small_batches

#: A unit carries a licence from this coefficient.
DICE = 0.8
#: Bigrams between two known ones of a span, at most and with the second of them.
GAP = 6

# Parts that several of the templates below have in common.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_MAY = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_MAY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE_MAY = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
_GPL_AS_IS = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
# Notices and texts of public licences, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE_MAY),
    ("Apache-2.0", _APACHE_AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", _BSD_MAY),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MIT", f"{_MIT_GRANT} {_MIT_KEEP} {_MIT_AS_IS}"),
    ("MIT-0", f"{_MIT_GRANT.removesuffix(', subject to the following conditions:')}. {_MIT_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_MAY} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_MAY} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_AS_IS}"),
    ("ISC", f"{_ISC_MAY}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_MAY}. {_ISC_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", f"{_APACHE_MAY} You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_AS_IS} See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    *((f"{name}-{number}-or-later", f"This program is free software{';' if number == '2.0' else ':'} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {number[0]} of the License, or (at your option) any later version. {_GPL_AS_IS.format(kind)} You should have received a copy of the GNU {kind}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.") for name, kind, number in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0"))),
    ("LGPL-2.1-or-later", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. {_GPL_AS_IS.format('Lesser ').replace('program', 'library')}"),
    *((f"{name}-{number}", f"GNU {kind}GENERAL PUBLIC LICENSE Version {number[0]}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.") for name, kind, number, date, year in (("GPL", "", "2.0", "June 1991", "1989, 1991"), ("GPL", "", "3.0", "29 June 2007", "2007"), ("LGPL", "LESSER ", "3.0", "29 June 2007", "2007"), ("AGPL", "AFFERO ", "3.0", "19 November 2007", "2007"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    *((f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for code, name in (("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
]

#: Normalisation: ASCII letters lower, everything else in ASCII that is no letter or digit a space.
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[i for i in range(128) if not chr(i).isalnum()]] = 32
_CLEAN[65:91] += 32
_NL, _SPACE = 10, np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _bigrams(h: np.ndarray) -> np.ndarray:
    return textvec.mix(h[:-1] * _STEP + h[1:])


class Templates:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.names, self.sets = [], []
        for name, text in templates:
            raw = _CLEAN[np.frombuffer(text.encode(), np.uint8)]
            h, _ = textvec.words(raw, np.array([0, len(raw)]))
            self.names.append(name)
            self.sets.append(np.unique(_bigrams(h)))
        self.size = np.array([len(s) for s in self.sets])
        self.known = np.unique(np.concatenate(self.sets))
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[self.known & np.uint64(0xFFFF)] = True

    def among(self, g: np.ndarray) -> np.ndarray:
        """Where the bigrams are in any template."""
        maybe = np.flatnonzero(self.seen[g & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.known, g[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == g[maybe]]

    def best(self, bigrams: np.ndarray, hits: int, dice: float) -> list[tuple[int, float, int]]:
        """(template, coefficient, shared bigrams) of those that reach ``dice`` for a set of ``bigrams``, ``hits`` of which are in some template."""
        n, out = len(bigrams), []
        # 2 x common >= dice x (n + size), and common is at most n, size and hits
        fit = (self.size * dice <= (2 - dice) * n) & (n * dice <= (2 - dice) * self.size) & (2 * hits >= dice * (n + self.size))
        for t in np.flatnonzero(fit):
            shared = len(np.intersect1d(bigrams, self.sets[t], assume_unique=True))
            value = 2 * shared / (n + int(self.size[t]))
            if value >= dice:
                out.append((int(t), value, shared))
        return out


def _starts(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind of unit, the number of the unit that each word (by its first byte) lies in; for spans that of the text."""
    n = len(raw)
    text = np.zeros(n + 1, bool)
    text[offsets] = True
    line = text.copy()
    line[1:] |= raw == _NL
    sentence = line.copy()
    sentence[2:] |= _STOP[raw[:-1]] & _SPACE[raw[1:]]
    # a blank line: only white space between two line ends
    ends = np.flatnonzero(raw == _NL)
    ink = np.concatenate([[0], np.cumsum(~_SPACE[raw])])
    block = text.copy()
    if len(ends) > 1:
        block[ends[1:][ink[ends[1:]] == ink[ends[:-1]]] + 1] = True
    return {k: np.cumsum(v)[start] for k, v in (("sentence", sentence), ("line", line), ("block", block), ("text", text), ("span", text))}


def scan_texts(texts: pa.Array, templates: Templates, dice: float = DICE) -> list[dict[str, tuple[float, int, int]]]:
    """For each text, the licences found: coefficient of the unit that shares most with it, number of units of different words that carry it, and bigrams shared."""
    out: list[dict[str, tuple[float, int, int]]] = [{} for _ in range(len(texts))]
    for first, raw, offsets in textvec.chunks(texts):
        clean = _CLEAN[raw]
        h, bounds = textvec.words(clean, offsets)
        if len(h) < 2:
            continue
        ink = clean != 32
        begin = ink.copy()
        begin[1:] &= ~ink[:-1]
        begin[offsets[:-1][offsets[:-1] < len(raw)]] = ink[offsets[:-1][offsets[:-1] < len(raw)]]
        start = np.flatnonzero(begin)
        g = _bigrams(h)
        hits = templates.among(g)
        owner = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
        done: set[tuple[int, int]] = set()
        for kind, unit in _starts(raw, offsets, start).items():
            inside = hits[unit[hits] == unit[hits + 1]]
            if not len(inside):
                continue
            if kind == "span":
                of = np.cumsum((np.diff(inside, prepend=inside[0]) > GAP) | (np.diff(unit[inside], prepend=unit[inside[0]]) > 0))
            else:
                of = unit[inside]
            ids, lo, n = np.unique(of, return_index=True, return_counts=True)
            for u, at, many in zip(ids, lo, n, strict=True):
                found = len(np.unique(g[inside[at : at + many]]))
                if 2 * found < dice * (found + templates.size.min()):
                    continue
                if kind == "span":
                    a, b = int(inside[at]), int(inside[at + many - 1]) + 2
                else:
                    a, b = int(np.searchsorted(unit, u, "left")), int(np.searchsorted(unit, u, "right"))
                if (a, b) in done:
                    continue  # the same words as a smaller kind of unit
                done.add((a, b))
                for t, value, shared in templates.best(np.unique(g[a : b - 1]), found, dice):
                    name, here = templates.names[t], out[first + int(owner[a])]
                    best, count, most = here.get(name, (0.0, 0, 0))
                    most, best = max((most, best), (shared, value))
                    here[name] = (best, count + 1, most)
    return out


def scan_licenses(spark: SparkSession, docs: DataFrame, dice: float = DICE) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, license, licenses, dice, n_units), a row for each.

    ``license`` is the one that shares most bigrams with a unit, then the one with the highest coefficient, then the first by name; ``dice`` is its coefficient
    there, ``licenses`` are all that were found, sorted and joined by a comma, ``n_units`` how many unit-template pairs reach ``dice``. None found, null or empty text: null,
    '', 0.0, 0. Null doc_ids and repeated rows stay as they are. Other columns go.
    """
    small_batches(spark)
    templates = Templates(TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan_texts(b.column(1), templates, dice)
            best = [min(f.items(), key=lambda x: (-x[1][2], -x[1][0], x[0]), default=(None, (0.0, 0, 0))) for f in found]
            columns = [b.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array([x[1][0] for x in best], pa.float64()), pa.array([sum(n for _, n, _ in f.values()) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "licenses", "dice", "n_units"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, licenses string, dice double, n_units long")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    clean = "list_filter(string_split(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g'), ' '), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT id, name, {pairs} AS g FROM (SELECT id, name, {clean.format('body')} AS w FROM (VALUES {values}) v(id, name, body))),
u AS (
  SELECT doc_id, {clean.format('coalesce(text, chr(32))')} AS w, 0 AS pos, 0 AS kind FROM documents
  UNION ALL SELECT doc_id, {clean.format('x')}, pos, 1 FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[\\x09-\\x0D ]*\\n') AS l FROM documents))
  UNION ALL SELECT doc_id, {clean.format('x')}, pos, 2 FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL SELECT doc_id, {clean.format('x')}, pos, 3 FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT doc_id,
    string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])([\\x09-\\x0D ])', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents))),
-- a unit with the words of a smaller kind, alone or beside wordless ones, is the same unit
v AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS upto FROM u WHERE len(w) > 1 OR len(w) = 1),
k AS (SELECT DISTINCT unnest(g) AS g FROM t),
b AS (SELECT doc_id, w, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM u WHERE kind = 0)),
h AS (SELECT doc_id, w, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {GAP} THEN 0 ELSE 1 END AS nw FROM b WHERE g IN (SELECT g FROM k)),
j AS (SELECT doc_id, w, i, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM h),
z AS (SELECT doc_id, max(i) + 1 AS upto, any_value(w)[min(i) : max(i) + 1] AS w FROM j GROUP BY doc_id, span),
d AS (SELECT DISTINCT doc_id, upto, w FROM v WHERE len(w) > 1 UNION SELECT doc_id, upto, w FROM z),
s AS (SELECT doc_id, {pairs} AS g FROM d),
m AS (SELECT s.doc_id, t.name, len(list_intersect(s.g, t.g)) AS shared, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice FROM s JOIN t ON len(t.g) * 0.8 <= 1.2 * len(s.g) AND len(s.g) * 0.8 <= 1.2 * len(t.g)),
n AS (SELECT doc_id, name, max(shared) AS shared, first(dice ORDER BY shared DESC, dice DESC) AS dice, count(*) AS n FROM m WHERE dice >= 0.8 GROUP BY doc_id, name),
r AS (SELECT doc_id, first(name ORDER BY shared DESC, dice DESC, name) AS license, string_agg(name, ',' ORDER BY name) AS licenses, first(dice ORDER BY shared DESC, dice DESC, name) AS dice, CAST(sum(n) AS BIGINT) AS n_units FROM n GROUP BY doc_id)
SELECT e.doc_id, r.license, coalesce(r.licenses, '') AS licenses, coalesce(r.dice, 0.0::DOUBLE) AS dice, coalesce(r.n_units, 0) AS n_units FROM documents e LEFT JOIN r ON e.doc_id = r.doc_id
"""


OP5_SQL = _oracle()
