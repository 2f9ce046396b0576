"""Licence scans: normalised text compared with licence templates by Dice coefficient over word bigrams.

Candidates are the whole text and every stretch of neighbouring lines that a template's size allows: if
Dice is at least t, a stretch of n bigrams and a template of m satisfy t m / (2 - t) <= n <= (2 - t) m / t.
By the same bound a stretch has at least t m / (2 - t) of the template's bigrams, so of any choice of more
than m minus that many it has at least one: a template is only compared around lines with a word of its
*probes*, the words of its rarest such bigrams (by how many templates have them). Bigrams are multisets,
so repeated phrases count as often as they occur.

Versions, variants and names decide between siblings: a stretch that names none of the template's version numbers
("version 3", "v3", "GPLv3"), or, from its first to its last bigram of the template, lacks a licence's name that the template has (GPL,
MIT, Apache) or has not just its variant words (Lesser, Affero; NonCommercial, ShareAlike, NoDerivatives, in one word or two), isn't that licence.

Where no stretch of lines has a licence, its templates are slid over the text by word, within lines
that are together too long for the template (shorter ones have been judged whole): the best stretch
begins and ends with a bigram of the template (leaving out others at its ends only raises Dice), so only
those are tried.

Normalisation: lower case (Unicode), everything but letters and digits (and the dot between digits)
separates words. Placeholders of templates (in angle brackets) are left out. A text of one word has no
bigram and no finding. Null texts have none either. Long texts are read whole; overlapping stretches
of one template give the best one (then the first, then the shortest), and of different licences the
better one; a text can have several licences in different words. A stretch grows word by word with a
count of what it shares, so the work is linear in the text (times the longest template). Repeated rows are
scanned alike, columns other than doc_id and text don't matter, and an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import COMMON

THRESHOLD = 0.8

# Public licences' texts and notices, placeholders in angle brackets.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the 3-clause BSD License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the 2-clause BSD License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/",
    ),
}

# Names of licence families and their versions; texts that siblings have but for these.
GNU = {"GPL": ("General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.1", "3.0")), "AGPL": ("Affero General Public License", ("3.0",))}
GNU_DATES = {"GPL-1.0": "February 1989", "GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
MORE: dict[str, tuple[str, ...]] = {
    "Apache-1.0": ("Licensed under the Apache License, Version 1.0.",),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",),
    "MPL-1.1": ("Licensed under the Mozilla Public License, version 1.1.", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    "MPL-2.0": ("Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",),
    "EPL-1.0": ("Licensed under the Eclipse Public License, version 1.0.",),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
}
# Short notices of licences by their abbreviations; SPDX identifiers that aren't of GNU.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT licensed.",),
    "Apache-2.0": ("Licensed under the Apache License 2.0.", "Licensed under Apache 2.0."),
    "BSD-2-Clause": ("Released under the Simplified BSD License.", "Licensed under the Simplified BSD License."),
    "BSD-3-Clause": ("Released under the New BSD License.", "Licensed under the New BSD License."),
    "MPL-2.0": ("Licensed under the MPL 2.0.",),
}
GNU_NOTICES = (
    "Licensed under the {}v{}.", "This file is licensed under the {}v{}.", "Licensed under the GNU {} v{}.", "Licensed under the GNU {} v{} or later.", "Licensed under the GNU {} version {}.", "Licensed under the GNU {} version {} or later."
)
SPDX = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "Unlicense", *(f"CC-{x}-4.0" for x in CC))


def siblings() -> dict[str, tuple[str, ...]]:
    """Notices of the other versions and variants of the families above, and how their whole texts begin."""
    out = {k: [*MORE.get(k, ()), *NOTICES.get(k, ())] for k in {*MORE, *NOTICES}}
    for family, (name, versions) in GNU.items():
        for v in versions:
            number, key = v.removesuffix(".0"), f"{family}-{v}"
            header = TEMPLATES[f"{family}-3.0"][0].replace("version 3 of the License", f"version {number} of the License")
            begins = f"GNU {name} Version {number}, {GNU_DATES[key]}"
            short = [x.format(family, number) for x in GNU_NOTICES] + [f"SPDX-License-Identifier: {key}{x}" for x in ("", "-only", "-or-later")]
            out[key] = [*short, f"This work is licensed under the GNU {name}, version {number}.", f"Licensed under the GNU {name}, version {number}.", header, begins]
    for short, name in CC.items():
        for v, scope in CC_VERSIONS.items():
            out[f"CC-{short}-{v}"] = [f"This work is licensed under a Creative Commons {name} {v} {scope} License.", f"Licensed under CC {short} {v}."]
    for key in SPDX:
        out.setdefault(key, []).append(f"SPDX-License-Identifier: {key}")
    return {k: tuple(t for t in v if t not in TEMPLATES.get(k, ())) for k, v in out.items()}


TEMPLATES = {k: (*TEMPLATES.get(k, ()), *siblings().get(k, ())) for k in sorted({*TEMPLATES, *siblings()})}
# Words that ordinary texts have.
ORDINARY = {*COMMON["en"], *"under which may not or any all you your this these if no more use used work works made make free available terms program version file files see name names own part new only later nd sa nc".split()}
#: Words that tell variants of a family apart, by how the licence's name begins.
VARIANTS = {"CC-": {"noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd"}, "GPL": {"lesser", "affero"}, "LGPL": {"lesser", "affero"}, "AGPL": {"lesser", "affero"}}

#: Licences' names, of which a stretch must have those that the template has.
NAMES = {"mit", "isc", "bsd", "apache", "mozilla", "eclipse", "gpl", "lgpl", "agpl", "mpl", "epl", "cc0", "unlicense"}

_WORD = re.compile(r"[^\W\d_]*\d+(?:\.\d+)+|[^\W_]+")
_VERSIONED = re.compile(r"([a-z]*)v(\d+(?:\.\d+)*)")

# Bytes other than ASCII letters and digits become spaces.
_BLANKED = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 0.0


def versions(words: list[str]) -> set[str]:
    """The version numbers that words name, without their ``.0``: dotted ones, whole ones after
    "version" or before "clause", and those after a name and a v."""
    near = zip(words, ["", *words], [*words[1:], ""])
    plain = {w.removesuffix(".0") for w, before, after in near if w[0].isdigit() and ("." in w or before in ("version", "v") or after == "clause")}
    return plain | {m[2].removesuffix(".0") for m in map(_VERSIONED.fullmatch, words) if m}


def names(words: list[str]) -> set[str]:
    """The licences' names among words, with or without a version."""
    return NAMES.intersection(m[1] if m else w for m, w in zip(map(_VERSIONED.fullmatch, words), words))


class Template:
    def __init__(self, license: str, text: str, threshold: float, often: Counter):
        words = words_of(re.sub(r"<[^>]*>", " ", text))
        self.license, self.words, self.bigrams = license, words, bigrams(words)
        self.apart = next((v for k, v in VARIANTS.items() if license.startswith(k)), set())
        self.versions, self.variants, self.names = versions(words), self._variants(words), names(words)
        m = len(words) - 1
        self.low, self.high = math.ceil(threshold * m / (2 - threshold) - 1e-9), math.floor((2 - threshold) * m / threshold + 1e-9)
        # more of the rarest bigrams than a stretch can be without
        take, self.probes = m - self.low + 1, set()
        whole = {g: [w for w in g if "." not in w or not w[0].isdigit()] for g in self.bigrams}
        rarest = {g: min(x, key=lambda w: (often[w], -len(w), w)) for g, x in whole.items() if x}
        for g in sorted(rarest, key=lambda g: (often[rarest[g]], g)):
            if take <= 0:
                break
            take -= self.bigrams[g]
            self.probes.add(rarest[g])

    def _variants(self, words: list[str]) -> set[str]:
        return self.apart.intersection(words) | self.apart.intersection(a + b for a, b in zip(words, words[1:]))

    def fits(self, words: list[str]) -> bool:
        """Whether words have a version of the template's, and between its first and last bigram its names, and its variant
        words only."""
        if self.versions and self.versions.isdisjoint(versions(words)):
            return False
        at = [i for i, g in enumerate(zip(words, words[1:])) if g in self.bigrams]
        span = words[at[0] : at[-1] + 2] if at else []
        return self.names <= names(span) and self._variants(span) == self.variants


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        often = Counter(w for texts in templates.values() for t in texts for w in set(words_of(t)))
        # words that any text may have are poor probes, short ones and numbers not the best
        often.update({w: 1000 if w in ORDINARY else 100 for w in list(often) if w in ORDINARY or len(w) < 4 or w[0].isdigit()})
        self.threshold = threshold
        self.templates = [Template(k, t, threshold, often) for k, texts in templates.items() for t in texts]
        # what comes before a dot is a word of its own to the first look at a text
        self.probes = {w.partition(".")[0].encode() for t in self.templates for w in t.probes}
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            for g in t.bigrams:
                self.index[g].append(i)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, dice, first line, last line), lines from 0: the best stretch of each licence,
        unless words of it are in a better one of another licence (of equal ones, the first by name)."""
        lower = text.lower()
        if self.probes.isdisjoint(lower.encode("utf-8", "surrogatepass").translate(_BLANKED).split()):
            return []
        lines = [_WORD.findall(x) for x in lower.split("\n")]
        ends = [0]
        for x in lines:
            ends.append(ends[-1] + len(x))
        flat = [w for x in lines for w in x]
        pairs, words = list(zip(flat, flat[1:])), set(flat)
        hits: dict[int, list[int]] = defaultdict(list)
        for k, g in enumerate(pairs):
            for i in self.index.get(g, ()):
                hits[i].append(k)
        near = [(t, hits[i]) for i, t in enumerate(self.templates) if len(hits.get(i, ())) >= t.low and not t.probes.isdisjoint(words)]
        best: dict[str, tuple] = {}
        for by_line in (True, False):
            before = set(best)
            for t, at in near:
                if by_line or t.license not in before:
                    found = self._best(flat, pairs, ends, t, at, by_line)
                    if found and (t.license not in best or found < best[t.license]):
                        best[t.license] = found
        out: list[tuple[str, float, int, int]] = []
        for (d, i, j), k in sorted((v, k) for k, v in best.items()):
            if all(j <= x[2] or i >= x[3] for x in out):
                out.append((k, -d, i, j))
        return sorted((k, d, bisect_right(ends, i) - 1, bisect_right(ends, j - 1) - 1) for k, d, i, j in out)

    def _best(self, words: list[str], pairs: list[tuple[str, str]], ends: list[int], t: Template, hits: list[int], by_line: bool) -> tuple[float, int, int] | None:
        """(-dice, first word, word after the last) of the best stretch of lines, or of words whose lines
        are too long for the template, if one reaches the threshold. ``hits``: where the template's bigrams
        are. Leaving out words (or lines) at either end that have none of them only raises Dice, so
        stretches begin and end with one."""
        m, best, last = len(t.words) - 1, None, -1
        for a, k in enumerate(hits):
            line = bisect_right(ends, k) - 1
            start = ends[line] if by_line else k
            if by_line and start == last:
                continue
            last = start
            # at most t.high bigrams, at least t.low of them the template's
            until = bisect_left(hits, start + t.high, a)
            if until - a < t.low:
                continue
            left, shared = dict(t.bigrams), 0
            for b in range(a, until):
                j = hits[b]
                if left[pairs[j]]:
                    left[pairs[j]] -= 1
                    shared += 1
                end = j + 2
                if by_line:
                    end = ends[bisect_right(ends, j + 1)]
                    if b + 1 < until and hits[b + 1] + 2 <= end:
                        continue  # the line goes on
                n = end - start - 1
                if t.low <= n <= t.high:
                    d = 2 * shared / (n + m)
                    if d >= self.threshold and (best is None or (-d, start, end) < best) and (by_line or ends[bisect_right(ends, j + 1)] - ends[line] - 1 > t.high) and t.fits(words[start:end]):
                        best = (-d, start, end)
        return best


def templates_from(folder: str) -> dict[str, tuple[str, ...]]:
    """More templates: the licences' whole texts, from files of a folder, named by their file names."""
    return {p.stem if p.suffix == ".txt" else p.name: (p.read_text(errors="replace"),) for p in sorted(Path(folder).iterdir()) if p.is_file()}


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: doc_id, licenses (names, in order), dice and lines (first and last, from
    0) of the best stretch of each, and n_licenses."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            scanner = scanner or Scanner(templates, threshold)
            found = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x[1] for x in f] for f in found], pa.list_(pa.float64())),
                    pa.array([[[x[2], x[3]] for x in f] for f in found], pa.list_(pa.list_(pa.int64()))),
                ],
                names=["doc_id", "n_licenses", "licenses", "dice", "lines"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_licenses long, licenses array<string>, dice array<double>, lines array<array<long>>")
