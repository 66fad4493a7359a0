"""License scans by conditional compression.

Candidate blocks are the stretches around license words. Each is compressed alone and with every template as zstandard
raw dictionary, which ranks the templates by the reduction in size. All that reduce it are then confirmed, or not, by the
exact wording differences of the stretch that aligns best: few words may differ, none of them one that tells licenses
apart (a name, a version, a negation), and no negation may stand before. Where confirmed stretches overlap, the one that
says more stays. Lines with license words outside of those are reported without a license.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CUE = r"(?i)licen[sc]e|copyright|copyleft|warrant|spdx|redistribut|all rights reserved|permission is hereby|public domain|creativecommons".replace(" ", "[^a-zA-Z0-9]+")  # over line breaks too
GAP = 4  # lines without a license word that a block may span
BRIEF = 24  # words of a template up to which it is sought in narrow blocks
WORDING = 0.9  # share of a template's words that must be there, in order

_SHORT = "This work is licensed under the GNU {0}, version {1}."
_NOTICE = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, version: str, dated: str, kinds: tuple[str, ...] = ("program",)) -> list[str]:
    """The one-line notice, the standard notice of a program or library, and the head of the license's full text."""
    head = f"GNU {name.upper()} Version {dated} Free Software Foundation, Inc. {_VERBATIM}"
    return [_SHORT.format(name, version), *(_NOTICE.format(k, name, version) for k in kinds), head]


_CC = "Creative Commons {0} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {0} 4.0 International Public License"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# Wordings of licenses, of the heads of their full texts and of their customary notices, by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [f"{_BSD} 3. {_ENDORSE}"],
    "BSD-4-Clause": [f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {_ENDORSE}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-1.0": _gnu("General Public License", "1", "1, February 1989 Copyright (C) 1989"),
    "GPL-2.0": _gnu("General Public License", "2", "2, June 1991 Copyright (C) 1989, 1991"),
    "GPL-3.0": _gnu("General Public License", "3", "3, 29 June 2007 Copyright (C) 2007"),
    "LGPL-2.0": _gnu("Library General Public License", "2", "2, June 1991 Copyright (C) 1991", ("library", "program")),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "2.1, February 1999 Copyright (C) 1991, 1999", ("library", "program")),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "3, 29 June 2007 Copyright (C) 2007", ("library", "program")),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "3, 19 November 2007 Copyright (C) 2007"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0 1. Definitions"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _CC.format("Attribution")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", _CC.format("Attribution-ShareAlike")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", _CC.format("Attribution-NonCommercial")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", _CC.format("Attribution-NoDerivatives")],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."],
    "All-Rights-Reserved": ["All rights reserved."],
}

_CUE = re.compile(CUE)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_PLACED = re.compile(r"[a-zA-Z0-9]+(?:\.[0-9]+)*")  # _WORD before lower(), which can change a text's length
_CLOSING = re.compile(r"[^\w\s]*")

# words that tell licenses apart or turn a notice round: no difference may hold one
_NAMES = frozenset(
    "gnu lesser library affero general public gpl lgpl agpl apache mit expat isc bsd mozilla mpl eclipse epl cddl creative commons cc cc0 by sa nc nd "
    "attribution sharealike share alike noncommercial commercial noderivatives derivatives unlicense zlib boost artistic advertising".split()
)
_NEGATIONS = frozenset("not no never neither nor non without except cannot isn aren wasn weren don doesn didn longer unless nothing none unlike".split())
_BEFORE_VERSION = frozenset("version versions v license licence public by sa nc nd attribution sharealike noncommercial noderivatives commons international cc0 gpl lgpl agpl mpl apache bsd".split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str, taken: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of each maximal run of lines from one with a license word to another, over gaps of GAP at most.
    Spans that are taken (in order) are left out: they end a block, and license words in them do not count."""
    out: list[tuple[int, int]] = []
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    starts, ends, last = [a for a, _ in taken], [b for _, b in taken], 0
    for m in _CUE.finditer(text):
        k = bisect_right(ends, m.start())  # the first taken span that ends after the word's start
        if k < len(taken) and starts[k] < m.end():
            continue
        first, final = bisect_right(lines, m.start()) - 1, bisect_right(lines, m.end() - 1) - 1
        lo = max(lines[first], ends[k - 1] if k else 0)
        hi = min(lines[final + 1] - 1 if final + 1 < len(lines) else len(text), starts[k] if k < len(taken) else len(text))
        if out and first - last <= GAP + 1 and not (k and out[-1][1] <= starts[k - 1]):
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
        last = final
    return out


@lru_cache(1)
def _compressors():
    import zstandard

    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    out = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            norm = " ".join(words(t)).encode()
            held = zstandard.ZstdCompressionDict(norm, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, norm.decode().split(), zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False)))
    return plain, out


def wording(template: list[str], block: list[str]) -> tuple[float, list[str], int]:
    """Share of the template's words found in order in the block, the words that are missing (-) or put in (+) between
    the first and the last that match, and the place of the first in the block."""
    ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    same = [o for o in ops if o[0] == "equal"]
    if not same:
        return 0.0, [f"-{w}" for w in template], 0
    lo, hi = same[0][3], same[-1][4]
    diff = []
    for kind, a, b, c, d in ops:
        if kind != "equal":
            diff += [f"-{w}" for w in template[a:b]]
            diff += [f"+{w}" for w in block[max(c, lo) : min(d, hi)]]
    return sum(b - a for _, a, b, _, _ in same) / len(template), diff, lo


def separates(side: list[str], differs: list[bool]) -> bool:
    """Whether a differing word of a side (template or text) tells licenses apart: a name, a negation, or a number
    after the word version or a license's name. Numbers of list items and years do not."""
    for i, (word, other) in enumerate(zip(side, differs, strict=True)):
        if other and (word in _NAMES or word in _NEGATIONS):
            return True
        if other and word[0].isdigit() and i and side[i - 1] in _BEFORE_VERSION:
            return True
        if other and re.fullmatch(r"v[0-9].*", word):
            return True
    return False


def _marks(side: list[str], diff: list[str], sign: str) -> list[bool]:
    """Marks the words of a side that are among the differences of a sign. diff holds them in the side's order."""
    gone, out = [d[1:] for d in diff if d[0] == sign], [False] * len(side)
    at = len(gone)
    for i in range(len(side) - 1, -1, -1):
        if at and gone[at - 1] == side[i]:
            out[i] = True
            at -= 1
    return out


def exact(template: list[str], stretch: list[str], diff: list[str]) -> bool:
    """Whether the differences are few and none of them separates licenses. A word that occurs both as a difference
    and otherwise counts where it occurs last, and a name counts wherever it occurs."""
    if len(diff) > (1 - WORDING) * len(template):
        return False
    return not diff or not (separates(template, _marks(template, diff, "-")) or separates(stretch, _marks(stretch, diff, "+")))


_ENDS = re.compile(r"[.!?;]\s|\n\s*\n")


def turned(text: str, start: int) -> bool:
    """Whether a negation stands before the stretch that begins at start, in its sentence, up to five words back. A line that
    begins with a capital begins a sentence."""
    lead = text[max(0, start - 160) : start]
    cut = [m.end() for m in _ENDS.finditer(lead)]
    if text[start : start + 1].isupper() and not _WORD.search(lead[lead.rfind("\n") + 1 :].lower()):
        return False
    return any(w in _NEGATIONS for w in words(lead[cut[-1] if cut else 0 :].replace("'", " "))[-5:])


def ranked(w: list[str], of: Sequence[int] | None = None) -> list[tuple[float, int]]:
    """(size reduction, template) of a block's words, the greatest reduction first; of: the templates to try."""
    raw = " ".join(w).encode()
    plain, held = _compressors()
    alone = len(plain.compress(raw))
    every = ((1 - len(held[i][2].compress(raw)) / alone, -i) for i in (range(len(held)) if of is None else of))
    return [(gain, -i) for gain, i in sorted(every, reverse=True)]


def judge(block: str) -> tuple[str | None, float, float, list[str], bool]:
    """(license, size reduction, wording share, differences, confirmed). Every template that reduces the size is
    compared word by word (or the first, if none does); the one with the greatest share, then the fewest differences,
    wins; of equal ones that with the greater reduction, then the one listed first."""
    w, best = words(block), None
    places, held = [m.start() for m in _WORD.finditer(block.lower())], _compressors()[1]
    for k, (gain, i) in enumerate(ranked(w)):
        if gain <= 0 and k:
            break
        name, template, _ = held[i]
        share, diff, lo = wording(template, w)
        # a longer template that is there in full says more than a shorter one
        ok = share >= WORDING and exact(template, w, diff) and not turned(block, places[lo])
        key = (ok, share * len(template) - len(diff) if ok else share, gain)
        if best is None or key > best[0]:
            best = (key, (name, gain, share, diff, ok))
    return best[1] if best else (None, 0.0, 0.0, [], False)


@lru_cache(1)
def _pieces() -> list[list[tuple[list[str], int]]]:
    """By template: (words, place in it) of its parts, one more than the differences it may have, so that each stretch
    that is confirmed holds one of its template's parts unchanged."""
    out = []
    for _, t, _ in _compressors()[1]:
        parts = int((1 - WORDING) * len(t)) + 1
        cuts = [len(t) * x // parts for x in range(parts + 1)]
        out.append([(t[a:b], a) for a, b in zip(cuts, cuts[1:])])
    return out


def align(template: list[str], w: list[str], at: int, most: int) -> tuple[int, int, int, list[str]] | None:
    """(start, end, words that match, differences) of the stretch of w with the fewest differences from the template,
    out of those whose words lie within `most` of where they lie if the template starts at `at`; None beyond `most`
    differences."""
    n, far = len(template), most + 1
    if w[max(at, 0) : at + n] == template:
        return at, at + n, n, []
    width = 2 * most + 1  # column c of row i stands before word at - most + i + c
    rows = [[0 if 0 <= at - most + c <= len(w) else far for c in range(width)]]
    for i in range(1, n + 1):
        up, row, base, word = rows[-1], [], at - most + i, template[i - 1]
        for c in range(width):
            j, cost = base + c, far
            if 0 <= j <= len(w):
                if j and w[j - 1] == word:
                    cost = up[c]
                if c + 1 < width:
                    cost = min(cost, up[c + 1] + 1)
                if c and j:
                    cost = min(cost, row[c - 1] + 1)
            row.append(cost)
        if min(row) > most:
            return None
        rows.append(row)
    c, i, diff, found = rows[n].index(min(rows[n])), n, [], []
    while i:
        j = at - most + i + c
        if j and w[j - 1] == template[i - 1] and rows[i][c] == rows[i - 1][c]:
            found.append(j - 1)
            i -= 1
        elif c and j and rows[i][c] == rows[i][c - 1] + 1:
            diff.append(f"+{w[j - 1]}")
            c -= 1
        else:
            diff.append(f"-{template[i - 1]}")
            i, c = i - 1, c + 1
    return found[-1], found[0] + 1, len(found), diff[::-1]


def _around(text: str, starts: list[int], ends: list[int], reach: int) -> list[tuple[int, int]]:
    """(first, last) places of the words within `reach` words of a license word. Ranges that meet are one; long ones
    are cut into blocks that overlap by `reach`, so that a template weighs enough in each to reduce its size."""
    out: list[tuple[int, int]] = []
    for m in _CUE.finditer(text):
        lo = max(0, bisect_right(ends, m.start()) - reach)
        hi = min(len(starts), bisect_left(starts, m.end()) + reach)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return [(p, min(hi, p + 4 * reach)) for lo, hi in out for p in range(lo, max(lo + 1, hi - reach), 3 * reach)]


def licenses_in(text: str) -> list[tuple[int, int, str, float, float, list[str]]]:
    """(start, end, license, size reduction, wording share, differences) of each stretch that a template is confirmed
    in, in order. Of stretches that overlap, the one with the most words less differences stays, then that of the
    greater reduction, then the one that begins and ends first, then the first by name."""
    placed = [(m.start(), m.end()) for m in _PLACED.finditer(text)]
    starts, ends = [a for a, _ in placed], [b for _, b in placed]
    w = [text[a:b].lower() for a, b in placed]
    plain, held = _compressors()
    brief = [i for i, (_, t, _) in enumerate(held) if len(t) <= BRIEF]
    longer = [i for i, (_, t, _) in enumerate(held) if len(t) > BRIEF]
    every: dict[tuple[int, int, int], tuple] = {}
    for of, reach in ((brief, BRIEF + 2), (longer, int(1.1 * max(len(t) for _, t, _ in held)) + 1)):
        for first, last in _around(text, starts, ends, reach):
            block = w[first:last]
            at_word: dict[str, list[int]] = defaultdict(list)
            for p, word in enumerate(block):
                at_word[word].append(p)
            for gain, i in ranked(block, of):
                if gain <= 0:
                    break
                name, template, c = held[i]
                tried = set()
                for piece, a in _pieces()[i]:
                    for p in at_word.get(piece[0], ()):
                        if p - a in tried or block[p : p + len(piece)] != piece:
                            continue
                        tried.add(p - a)
                        got = align(template, block, p - a, int((1 - WORDING) * len(template)))
                        if not got or (i, first + got[0], first + got[1]) in every:
                            continue
                        lo, hi, same, diff = got
                        if exact(template, block[lo:hi], diff) and not turned(text, placed[first + lo][0]):
                            raw = " ".join(block[lo:hi]).encode()
                            own = 1 - len(c.compress(raw)) / len(plain.compress(raw))
                            every[i, first + lo, first + hi] = (-(same - len(diff)), -own, first + lo, first + hi, name, same / len(template), diff)
    los, his, out = [], [], []
    for _, own, lo, hi, name, share, diff in sorted(every.values(), key=lambda x: x[:5]):
        k = bisect_left(his, lo + 1)
        if k < len(los) and los[k] < hi:
            continue
        los.insert(k, lo)
        his.insert(k, hi)
        out.append((placed[lo][0], _CLOSING.match(text, placed[hi - 1][1]).end(), name, -own, share, diff))
    return sorted(out, key=lambda x: x[0])


_KINDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_chars", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("wording", pa.float64()), ("differences", pa.string()), ("confirmed", pa.bool_())]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            held = licenses_in(text)
            found = [(*x, True) for x in held]
            # what no template is confirmed in has no license; the nearest template shows how far off it is
            found += [(s, e, None, *judge(text[s:e])[1:4], False) for s, e in blocks(text, [x[:2] for x in held])]
            for s, e, name, gain, share, diff, ok in sorted(found, key=lambda x: x[0]):
                rows.append((doc_id, s, e - s, name, round(gain, 6), round(share, 6), " ".join(diff), ok))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def scan(docs: DataFrame) -> DataFrame:
    """documents -> one row per stretch with a confirmed license, and one per candidate block outside of those: doc_id,
    start and n_chars (characters of the text), license (null for a block), reduction, wording, differences, confirmed.

    Documents without a license word (null and empty ones too) give no rows; repeated rows give repeated findings;
    how ties are settled is said in licenses_in and judge; further columns are ignored; nothing is shuffled."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike(CUE))
    return some.mapInArrow(_found, "doc_id long, start long, n_chars long, license string, reduction double, wording double, differences string, confirmed boolean")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
