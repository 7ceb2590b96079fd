"""License scans by conditional compression: each template is a zstandard raw dictionary for the candidate blocks.

A text is one run of words, so a notice may be wrapped over lines and stand anywhere. A variant lacks at most the share
VARIANT of a template's words, so of any few more of them it has one: the longest such are the template's cues. Texts
with a cue of any template are candidates, and around each cue the template is laid with its own cue on that word, over a
window as much longer as a variant may be. There the wording is confirmed word by word: the words that differ are listed,
`exact` where there are none and `variant` where they are at most VARIANT of the template's words. A confirmed passage's
gain is the share of its compressed size that the template saves. Exact passages go first, then those that save most
bytes; each that overlaps no better one is found.

Defined results: null and empty texts have no findings; a notice that repeats is found each time; block is the number
of the line in which it begins; ties in rank go to the name first in alphabetical order; rows that repeat an id are
scanned each; templates without words find nothing; an empty table gives an empty result. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_arrow, narrow, remembered

# Whole texts of short licences, the opening words of long ones, and notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
VARIANT, GAIN, LEVEL = 0.34, 0.2, 19
WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: White space and the marks that comments begin lines with.
BETWEEN = re.compile(r"[\s#*/;]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def cues(template: list[str]) -> dict[str, list[int]]:
    """Words of which every variant has one, and their places: the longest, one more of them than a variant may lack."""
    longest = sorted(range(len(template)), key=lambda i: (-len(template[i]), i))[: int(VARIANT * len(template)) + 1]
    out: dict[str, list[int]] = {}
    for i in longest:
        out.setdefault(template[i], []).append(i)
    return out


@remembered("licences")
def prepared(templates: tuple[tuple[str, str], ...]):
    plain, seeker = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), ahocorasick.Automaton()
    by = []
    for name, text in templates:
        if own := words_of(text):  # a template without words has no wording to confirm
            known = zstandard.ZstdCompressionDict(BETWEEN.sub(" ", text).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            for w in cues(own):
                seeker.add_word(w, w)
            by.append((name, own, cues(own), Counter(own), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=known)))
    seeker.make_automaton()
    return plain, by, seeker


def align(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]]:
    """(start, end, missing, extra) of the passage of words with fewest differences: template words that it lacks, and
    words that it adds between them."""
    match = [m for m in difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    spans = [match[p:q] for p in range(len(match)) for q in range(p + 1, len(match) + 1)]
    best = min(spans, key=lambda s: len(template) + s[-1].b + s[-1].size - s[0].b - 2 * sum(m.size for m in s), default=[])
    if not best:
        return 0, 0, template, []
    start, end = best[0].b, best[-1].b + best[-1].size
    mine, theirs = ({i for m in best for i in range(at(m), at(m) + m.size)} for at in (lambda m: m.a, lambda m: m.b))
    return start, end, [w for i, w in enumerate(template) if i not in mine], [words[i] for i in range(start, end) if i not in theirs]


def scan_text(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, float, str, str, str]]:
    """(block, license, gain, status, missing, extra) of each passage that a template's wording confirms."""
    plain, by, seeker = prepared(templates)
    if not by or next(seeker.iter(text.lower()), None) is None:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    found = {}
    for name, own, marks, times, c in by:
        most, slack = VARIANT * len(own), int(VARIANT * len(own)) + 1
        if len(own) - sum(min(n, len(at.get(w, ()))) for w, n in times.items()) > most:
            continue  # the whole text lacks too many of its words
        lows, before = [], None
        for low in sorted({max(0, i - j - slack) for w, places_of in marks.items() for i in at.get(w, ()) for j in places_of}):
            if before is None or low > before + slack:  # its window holds those of the next `slack` places too
                lows.append(before := low)
        for low in lows:
            window = words[low : low + len(own) + 3 * slack]
            there = set(window)
            if sum(n for w, n in times.items() if w not in there) > most:
                continue
            start, end, missing, extra = align(own, window)
            if len(missing) + len(extra) > VARIANT * len(own):
                continue
            start, end = start + low, end + low
            data = BETWEEN.sub(" ", text[places[start][0] : places[end - 1][1]]).lower().encode()
            alone, size = len(plain.compress(data)), len(c.compress(data))
            if 1 - size / alone >= GAIN:
                found[start, end, name] = (bool(missing or extra), size - alone, name, start, end, round(1 - size / alone, 6), " ".join(missing), " ".join(extra))
    out, taken = [], set()
    for differs, _, name, start, end, gain, missing, extra in sorted(found.values()):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            out.append((places[start][0], name, gain, "variant" if differs else "exact", missing, extra))
    return [(text.count("\n", 0, at), *rest) for at, *rest in sorted(out)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, block, license, gain, status, missing, extra: a row for each passage with a licence."""
    known = tuple(sorted(templates.items()))
    rows = narrow(docs, id_col, text_col)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out += [(doc_id, *found) for found in scan_text(text, known)]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "block", "license", "gain", "status", "missing", "extra"])

    return map_arrow(rows, scan, "doc_id long, block int, license string, gain double, status string, missing string, extra string", uses="licences")
