"""Operator 5, license scans by conditional compression.

Every cue, a word of license notices, anywhere in a text is laid on each such word of each template: the block is the
template's number of words there, and the differences allowed on either side, across line ends. Its words, in lower case, are compressed with
zstandard on its own and with the template as a raw dictionary; a template that saves less than LEAST_GAIN of the block is
out, the others are ranked by how much smaller the block gets and confirmed by exact wording: the template's words are
aligned with the block's, and what differs is counted. A changed number (a version), name of a license or word with a hyphen,
or more differences than DIFFERENT of the template's words, rejects. Any number of templates may be confirmed at one place:
of notices that overlap, one inside a longer one goes, then the one with fewest differences stays, then the one with the
larger saving, then the first by name and place.

Templates are sentences, whole texts of short licenses, grants from the headers of files, the first lines of long licenses,
deeds and identifier tags. A license text of which a part is missing is found by the sentence that is left. A notice none of whose cue words
is left as the template has it isn't found.

Whole texts are scanned, whatever their lines. Null and empty texts give no rows. A notice that repeats in a text gives a row
for each place, with the line where it begins. Rows that share a doc_id are each scanned. Other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import prepare

#: Wordings of license notices. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
    "All-rights-reserved": "All rights reserved.",
}
#: What follows is public wording of licenses, their headers, deeds and tags. Fixed values.
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GRANT = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
_ONLY = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {n} as published by the Free Software Foundation."
_OPENING = "GNU {name} Version {n}, {day} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEXTS = [
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _ENDORSE + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "under the Apache License 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    *[(k, w.format(what=what, name=name, n=n)) for k, what, name, n in [("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3")] for w in (_GRANT, _ONLY)],
    *[(k, _OPENING.format(name=name, n=n, day=day, year=day[-4:])) for k, name, n, day in [("GPL-2.0", "GENERAL PUBLIC LICENSE", "2", "June 1991"), ("GPL-3.0", "GENERAL PUBLIC LICENSE", "3", "29 June 2007"), ("LGPL-2.1", "LESSER GENERAL PUBLIC LICENSE", "2.1", "February 1999"), ("LGPL-3.0", "LESSER GENERAL PUBLIC LICENSE", "3", "29 June 2007"), ("AGPL-3.0", "AFFERO GENERAL PUBLIC LICENSE", "3", "19 November 2007")]],
    *[(f"CC-{k}-{n}", f"licensed under a Creative Commons {name} {n} {where} License") for k, name in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")] for n, where in [("3.0", "Unported"), ("4.0", "International")]],
    *[(k, f"SPDX-License-Identifier: {k}") for k in ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]],
]
#: Words that tell licenses apart.
NAMES = {"mit", "bsd", "isc", "apache", "gnu", "gpl", "lgpl", "agpl", "mpl", "general", "lesser", "library", "affero", "mozilla", "boost", "zlib", "eclipse", "artistic", "unlicense", "cc", "attribution", "sharealike", "noncommercial", "noderivatives", "noderivs"}
CUE = r"(?i)licen[sc]e|copyright|permission|permitted|public\W+domain|rights\W+reserved|\bCC0\b|\bCC\W+BY"
DIFFERENT, LEAST_GAIN = 0.2, 0.25
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+(?:-[^\W\d_]+)*")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def differences(template: list[str], block: list[str]) -> tuple[int, bool, int, int]:
    """Template words that are changed, left out or broken up by other words, whether a number, the name of a license or a word with a hyphen changed, and the block's words from the first to the last that agree."""
    n, fixed = 0, False
    ops = [x for x in difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()]
    for k, (op, a, b, c, d) in enumerate(ops):
        if op == "equal" or (op == "insert" and k in (0, len(ops) - 1)):
            continue
        changed = template[a:b]
        # words before and after the notice aren't changes of it
        extra = block[c:d] if k not in (0, len(ops) - 1) else []
        n += max(len(changed), len(extra))
        fixed |= any(w[0].isdigit() or "-" in w or w in NAMES for w in changed + extra)
    same = [(c, d) for op, _, _, c, d in ops if op == "equal"]
    return n, fixed, same[0][0] if same else 0, same[-1][1] if same else 0


_FIND = re.compile(CUE)


def _cues(text: str, starts: list[int]) -> list[tuple[int, str]]:
    """Number of the word in which each cue begins, and the kind of cue."""
    out = []
    for m in _FIND.finditer(text):
        kind = re.sub(r"\W+", " ", m.group().lower())
        out.append((bisect_right(starts, m.start()) - 1, "license" if kind.startswith("licen") else kind))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, kept: int = 50_000):
        every = [*TEMPLATES.items(), *TEXTS] if templates is None else list(templates.items())
        self.names, self.words = [k for k, _ in every], [wording(t) for _, t in every]
        make = zstandard.ZstdCompressor
        self.plain = make(level=3, write_content_size=False, write_checksum=False)
        self.given = [make(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for w in self.words]
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(every):
            for at, kind in _cues(t, [m.start() for m in _WORD.finditer(t)]):
                self.anchors.setdefault(kind, []).append((k, at))
        self.seen: dict[tuple[int, str], tuple] = {}
        self.kept = kept

    def _try(self, k: int, words: list[str]) -> tuple[float, int, bool, int, int]:
        """Share of bytes that template k saves of a block, and differences()."""
        block = " ".join(words)
        found = self.seen.get((k, block))
        if found is None:
            data = block.encode(errors="replace")
            gain = 1 - len(self.given[k].compress(data)) / len(self.plain.compress(data))
            found = (gain, *(differences(self.words[k], words) if gain >= LEAST_GAIN else (0, True, 0, 0)))
            if len(self.seen) < self.kept and len(block) < 1000:
                self.seen[k, block] = found
        return found

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, share of bytes saved, differences, place) of the confirmed notices of a text, in order of place."""
        if not _FIND.search(text):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        starts, words = [a for a, _ in spans], wording(text)
        hits, whole = set(), [0] * len(self.words)
        for at, kind in _cues(text, starts):
            best: dict[int, tuple] = {}
            for k, own in self.anchors.get(kind, ()):
                # the cue is part of this very wording, found by an earlier cue
                if at < whole[k]:
                    continue
                n = len(self.words[k])
                more = int(DIFFERENT * n)
                a, b = max(0, at - own - more), min(len(spans), at - own + n + more)
                gain, different, fixed, x, y = self._try(k, words[a:b])
                passes = gain >= LEAST_GAIN and not fixed and different <= DIFFERENT * n
                # a template's best block: the one whose wording passes, then the largest saving
                best[k] = max(best.get(k, (False, -1.0)), (passes, gain, -different, a + x, a + y))
            for k, (passes, gain, same, x, y) in best.items():
                if passes:
                    hits.add((-same, -gain, k, x, y))
                    if same == 0:
                        whole[k] = max(whole[k], y)
        size = lambda h: len(self.words[h[2]])
        hits = sorted(hits, key=lambda h: (h[3], h[4]))
        longest, firsts = max((h[4] - h[3] for h in hits), default=0), [h[3] for h in hits]
        near = lambda h: hits[bisect_left(firsts, h[3] - longest) : bisect_right(firsts, h[4])]
        inside = lambda h: any(g[3] <= h[3] and h[4] <= g[4] and g[4] - g[3] > h[4] - h[3] and size(g) > size(h) for g in near(h))
        out, taken = [], set()
        # the exact wording decides among those that pass
        for n, gain, k, a, b in sorted((h for h in hits if not inside(h)), key=lambda h: (h[0], h[1], self.names[h[2]], h[3])):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                out.append((self.names[k], -gain, n, starts[a]))
        return sorted(out, key=lambda x: x[3])


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line, license, saved, differences: the best confirmed template of each place with a notice."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(CUE))

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            found = []
            for i, t in enumerate(T.rows_with(batch, "text")):
                text = t.as_py()
                line, done = 0, 0
                for name, gain, n, at in scanner.scan(text):
                    line, done = line + text.count("\n", done, at), at
                    found.append((i, line, name, gain, n))
            at, line, name, gain, n = zip(*found) if found else ([],) * 5
            yield pa.record_batch(
                [T.rows_with(batch, "doc_id").take(pa.array(at, pa.int64())), pa.array(line, pa.int32()), pa.array(name, pa.string()), pa.array(gain, pa.float64()), pa.array(n, pa.int32())],
                names=["doc_id", "line", "license", "saved", "differences"],
            )

    return texts.mapInArrow(run, "doc_id long, line int, license string, saved double, differences int")
