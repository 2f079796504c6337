"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into word n-grams, of which winnowing keeps the least hash
of every :data:`WINDOW` in a row; an inverted index leads from a fingerprint
to templates and places. Every n-gram of a text is looked up, so each run of
``WINDOW + n - 1`` words that a text shares with a template is found (of a
shorter template, the whole). The places tell the diagonals on which the
template may lie; along each it is aligned with the text inside a band (match
+2, mismatch or gap -1). Reported are the share of the template's words that
match, and the spans of the text, in characters.

A template that a text repeats is reported with a span for each time. Texts
are read in place and whole; nothing is shuffled. The templates are part of
the library or given by the caller, and go to the tasks with the function; more
than :data:`MOST_TEMPLATES` characters of them are an error.

Defined results: null and empty texts, and templates without words, match
nothing. Case and punctuation do not count. Templates that match the same
words are reported each. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store, textvec

GRAM, WINDOW = 3, 4
COVERAGE = 0.8
#: Most characters of all templates together: some 50 MB in a task with their index.
MOST_TEMPLATES = 4_000_000
MATCH, MISMATCH, GAP = 2, 1, 1

#: Notices and clauses of common licenses, and (``-text``) whole licenses and whole headers.
TEMPLATES = (
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC-text", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD-text", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause-text", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause-text", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0-text", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0-header-text", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
)
Templates = tuple[tuple[str, str], ...]


def winnowed(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: of every window the last of the least hashes."""
    if not len(grams):
        return []
    chosen = {max(range(low, min(low + window, len(grams))), key=lambda k: (-int(grams[k]), k)) for low in range(max(1, len(grams) - window + 1))}
    return sorted(chosen)


@lru_cache(maxsize=4)
def _index(templates: Templates) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each template; sorted fingerprints with the template and place of each."""
    hashes, _, _, at = textvec.words(pa.array([t.lower() for _, t in templates], pa.string()))
    grams, offsets = textvec.shingles(hashes, at, GRAM)
    found = sorted((int(grams[low + k]), t, k) for t, (low, high) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) for k in winnowed(grams[low:high]))
    return np.split(hashes, at[1:-1]), np.array([f for f, _, _ in found], np.uint64), np.array([t for _, t, _ in found], np.int64), np.array([k for _, _, k in found], np.int64)


def banded(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """The best local alignment near a diagonal: (template words that match, first word, end).

    Row i and column d of the table stand for template word i and text word
    ``i + shift + d - band``.
    """
    n, width = len(template), 2 * band + 1
    table = np.zeros((n + 1, width), np.int32)
    slope = np.arange(width, dtype=np.int32) * GAP
    base = np.arange(width) + shift - band
    for i in range(1, n + 1):
        at = base + i - 1
        inside = (at >= 0) & (at < len(words))
        step = np.where(inside & (words[np.clip(at, 0, len(words) - 1)] == template[i - 1]), MATCH, -MISMATCH)
        row = np.maximum(table[i - 1] + step, 0)
        row[:-1] = np.maximum(row[:-1], table[i - 1, 1:] - GAP)
        row = np.maximum.accumulate(row + slope) - slope
        table[i] = np.where(inside, row, 0)
    i, d = divmod(int(table.argmax()), width)
    end = base[d] + i
    matched, first = 0, end
    while i > 0 and table[i, d] > 0:
        at = base[d] + i - 1
        same = bool(words[at] == template[i - 1])
        if table[i, d] == table[i - 1, d] + (MATCH if same else -MISMATCH):
            matched += same
            first = at if same else first
            i -= 1
        elif d + 1 < width and table[i, d] == table[i - 1, d + 1] - GAP:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, int(first), int(end)


def scanned(templates: Templates, words: np.ndarray, grams: np.ndarray, threshold: float) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Of one text: (template, most words matched, spans in words) for each template found."""
    own, prints, owner, place = _index(templates)
    low, high = np.searchsorted(prints, grams, "left"), np.searchsorted(prints, grams, "right")
    shifts: dict[int, set[int]] = {}
    for at in np.flatnonzero(high > low).tolist():
        for k in range(low[at], high[at]):
            shifts.setdefault(int(owner[k]), set()).add(at - int(place[k]))
    out = []
    for t, found in sorted(shifts.items()):
        template = own[t]
        band = len(template) // 8 + 4
        spans: dict[tuple[int, int], int] = {}
        left = words
        last = None
        for shift in sorted(found):
            if last is not None and shift - last <= band // 2:
                continue  # inside the band of the last one
            last = shift
            while True:
                matched, first, end = banded(template, left, shift, band)
                if matched < threshold * len(template):
                    break
                spans[(first, end)] = matched
                left = left.copy()
                left[first:end] = 0  # of no word: what repeats the template within the band is found next
        kept: list[tuple[int, int]] = []
        for span in sorted(spans, key=lambda s: (-spans[s], s)):
            if all(span[1] <= a or span[0] >= b for a, b in kept):
                kept.append(span)
        if kept:
            out.append((t, max(spans[s] for s in kept), sorted(kept)))
    return out


_LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)


def scan(docs: DataFrame, templates: Templates = TEMPLATES, threshold: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, spans) for each document and template whose coverage reaches the threshold."""
    names = ["doc_id", "license", "coverage", "matched_words", "spans"]
    if sum(len(t) for _, t in templates) > MOST_TEMPLATES:
        raise ValueError(f"templates of more than {MOST_TEMPLATES} characters: scan with a part of them at a time")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, prints, _, _ = _index(templates)
        maybe = np.zeros(1 << 16, bool)
        maybe[(prints & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in textvec.portions(batches):
            data, offsets = textvec.flat(batch.column(1))
            starts, ends, at = textvec.spans(data, offsets)
            hashes = textvec.span_hashes(_LOWER[data], starts, ends)
            grams, gram_at = textvec.shingles(hashes, at, GRAM)
            hits = np.flatnonzero(maybe[(grams & np.uint64(0xFFFF)).astype(np.int64)])
            hits = hits[np.isin(grams[hits], prints)]
            ids = batch.column(0).to_pylist()
            rows = []
            for i in np.unique(np.searchsorted(gram_at, hits, "right") - 1).tolist():
                found = scanned(templates, hashes[at[i] : at[i + 1]], grams[gram_at[i] : gram_at[i + 1]], threshold)
                if not found:
                    continue
                place = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])  # characters before each byte
                for t, matched, spans in found:
                    text = ",".join(f"{place[starts[at[i] + a] - offsets[i]]}:{place[ends[at[i] + b - 1] - offsets[i]]}" for a, b in spans)
                    rows.append((ids[i], templates[t][0], round(matched / len(own[t]), 6), matched, text))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return store.mapped(ready, run, "doc_id long, license string, coverage double, matched_words long, spans string")
