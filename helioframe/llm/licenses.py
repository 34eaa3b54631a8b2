"""License notices in texts: candidate blocks, conditional compression, exact wording.

1. A text is cut into lines. Lines that hold a word of ``ANCHORS`` are candidates; candidates at most twice
   ``NEAR`` lines apart and the lines between them form one block, with up to ``NEAR`` lines before and after,
   so a notice of several lines is one block. Of a very long line only the ``REACH`` characters around its
   anchors count.
2. Each block is compressed alone and with every template as a raw Zstandard dictionary. What the template
   saves is its information about the block; templates are ranked by the bytes saved.
3. All that save anything are confirmed on words, best first: the template is aligned with the block, and the words
   to delete and insert between its first and last common word are the wording differences. A template is confirmed if
   they are at most ``ALLOWED`` of its words. The confirmed stretch is blanked and the block ranked again, so
   several notices in one block are all found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.text import ready

NEAR = 2
REACH = 4096
MARGIN = 600           # characters of the lines before and after
ALLOWED = 0.1
LEVEL = 3

# -- fixed values: wording of public license notices ------------------------------------------------
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License.""",
    "MIT-line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
ANCHORS = ("licens", "licenc", "rights reserved", "copyright", "warrant", "redistribut", "permission", "public domain", "mozilla.org/mpl", "apache.org", "merchantability", "sublicens")
# ------------------------------------------------------------------------------------------------------

_ANCHOR = re.compile("|".join(map(re.escape, ANCHORS)), re.IGNORECASE)
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

FINDINGS = ("license string, start bigint, end bigint, block_start bigint, block_end bigint, plain_bytes bigint, with_template_bytes bigint, "
            "saved_bytes bigint, rank bigint, template_words bigint, wrong_words bigint, differences array<string>")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Candidate stretches of a text, in characters."""
    if not _ANCHOR.search(text):
        return
    current: tuple[int, int, int] | None = None
    line, at = 0, 0
    for content in text.split("\n"):
        hits = [m.span() for m in _ANCHOR.finditer(content)]
        for low, high in hits:
            a, b = max(0, low - REACH), min(len(content), high + REACH)
            if current is not None and (line == current[2] and at + a <= current[1] or line != current[2] and line - current[2] <= 2 * NEAR):
                current = current[0], max(current[1], at + b), line
            else:
                if current is not None:
                    yield _widened(text, *current[:2])
                current = at + a, at + b, line
        at, line = at + len(content) + 1, line + 1
    if current is not None:
        yield _widened(text, *current[:2])


def _widened(text: str, begin: int, end: int) -> tuple[int, int]:
    """With whole lines around, where the block does not end inside a line."""
    if begin and text[begin - 1] == "\n":
        before = text[max(0, begin - MARGIN):begin].split("\n")
        begin -= len("\n".join(before[-NEAR - 1:]))
    if text[end:end + 1] == "\n":
        end += len("\n".join(text[end:end + MARGIN].split("\n")[:NEAR + 1]))
    return begin, end


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    def build(text: str | None) -> zstandard.ZstdCompressor:
        used = None if text is None else zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=used, write_checksum=False, write_content_size=False, write_dict_id=False)
    return build(None), {name: build(text) for name, text in TEMPLATES.items()}


@cache
def _template_words(name: str) -> list[str]:
    return words(TEMPLATES[name])[0]


def rank(block: bytes) -> tuple[int, list[tuple[int, int, str]]]:
    """Size alone, and (bytes saved, size, template) of all templates that save anything, best first."""
    alone, others = _compressors()
    plain = len(alone.compress(block))
    sizes = [(plain - size, size, name) for name, c in others.items() if (size := len(c.compress(block))) < plain]
    return plain, sorted(sizes, key=lambda x: (-x[0], x[2]))


def confirm(name: str, tokens: list[str]) -> tuple[int, int, int, list[str]] | None:
    """First and last word of the notice, the number of wrong words, and which; None if it is not there."""
    template = _template_words(name)
    allowed = int(len(template) * ALLOWED)
    best = None
    match = SequenceMatcher(None, template, tokens, autojunk=False)
    # the longest common run fixes where the template would lie; compare it with that stretch alone
    core = match.find_longest_match()
    if not core.size:
        return None
    low = max(0, core.b - core.a - allowed)
    high = min(len(tokens), core.b + len(template) - core.a + allowed)
    part = SequenceMatcher(None, template, tokens[low:high], autojunk=False)
    same = [b for b in part.get_matching_blocks() if b.size]
    first, last = low + same[0].b, low + same[-1].b + same[-1].size
    wrong, told = 0, []
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, template, tokens[first:last], autojunk=False).get_opcodes():
        if kind != "equal":
            wrong += max(i2 - i1, j2 - j1)
            told.append(f"-{' '.join(template[i1:i2])} +{' '.join(tokens[first + j1:first + j2])}")
    if wrong <= allowed:
        best = first, last, wrong, told
    return best


def scan(text: str) -> list[tuple]:
    """All findings of a text, in the order of their places."""
    out = []
    for begin, end in blocks(text):
        block = text[begin:end]
        while True:
            plain, ranked = rank(block.encode())
            tokens, spans = words(block)
            found = None
            for place, (saved, size, name) in enumerate(ranked, 1):
                hit = confirm(name, tokens)
                if hit is not None:
                    found = place, saved, size, name, hit
                    break
            if found is None:
                break
            place, saved, size, name, (first, last, wrong, told) = found
            a, b = spans[first][0], spans[last - 1][1]
            out.append((name, begin + a, begin + b, begin, end, plain, size, saved, place, len(_template_words(name)), wrong, told))
            block = block[:a] + " " * (b - a) + block[b:]
            if not _ANCHOR.search(block):
                break
    return sorted(out, key=lambda r: r[1:3])


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice found: key, license, its place in characters, the sizes, the rank, the wording differences.

    Null, empty and blank texts hold no notice; rows with equal or null keys are scanned one by one; other
    columns are not read; of templates that save equally many bytes the name decides.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    # texts without an anchor have no block; most end here, before Python
    rows = rows.filter(F.col("_text").rlike("(?i)" + "|".join(re.escape(a) for a in ANCHORS)))
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, {FINDINGS}"
    names = [c.split()[0] for c in FINDINGS.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, found = [], []
            for i, content in enumerate(batch.column(1)):
                hits = scan(content.as_py())
                picked += [i] * len(hits)
                found += hits
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            types = [pa.string() if n == "license" else pa.list_(pa.string()) if n == "differences" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, *names])

    return rows.mapInArrow(step, schema)
