"""Licence scan: canonical digests of entire texts, joined by hash to those of known licences.

Texts are the whole document, each of its lines and paragraphs, and each run of paragraphs that begins as a known text does and
ends at its length. Case, punctuation, copyright lines and equivalent spellings are normalised away before the digest is taken.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ROW, cut, map_texts

#: Identifier, permissive or not, and the names by which notices refer to it.
NAMES: list[tuple[str, bool, list[str]]] = [
    ("Apache-2.0", True, ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"]),
    ("MIT", True, ["MIT License", "MIT"]),
    ("BSD-2-Clause", True, ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", True, ["BSD 3-Clause License", "New BSD License", "BSD License"]),
    ("ISC", True, ["ISC License", "ISC"]),
    ("MPL-2.0", False, ["Mozilla Public License, Version 2.0", "MPL 2.0"]),
    ("MPL-1.1", False, ["Mozilla Public License, Version 1.1", "MPL 1.1"]),
    ("Artistic-1.0", True, ["Artistic License 1.0"]),
    ("GFDL-1.2", False, ["GNU Free Documentation License, version 1.2"]),
    ("GFDL-1.3", False, ["GNU Free Documentation License, version 1.3"]),
    ("GPL-1.0", False, ["GNU General Public License, version 1"]),
    ("GPL-2.0", False, ["GNU General Public License, version 2", "GPLv2", "GPL-2.0"]),
    ("GPL-3.0", False, ["GNU General Public License, version 3", "GPLv3", "GPL-3.0"]),
    ("LGPL-2.0", False, ["GNU Library General Public License, version 2"]),
    ("LGPL-2.1", False, ["GNU Lesser General Public License, version 2.1"]),
    ("LGPL-3.0", False, ["GNU Lesser General Public License, version 3", "LGPLv3"]),
    ("AGPL-3.0", False, ["GNU Affero General Public License, version 3", "AGPLv3"]),
    ("CC0-1.0", True, ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"]),
    ("CC-BY-4.0", True, ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", False, ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", False, ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("Unlicense", True, ["Unlicense"]),
]
NOTICES = ["{}", "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This software is released under {}", "This project is licensed under {}", "SPDX-License-Identifier: {}", "License: {}"]
#: Fixed licence texts.
TEXTS: dict[str, str] = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>',
}
#: The entire texts of longer licences in normal form, with and without what follows their terms: licence, opening, length, digest.
FULL: list[tuple[str, str, int, str]] = [
    ("Apache-2.0", "apache license v2 0 ", 9230, "024e9ca570354eb392f62acd22ee074971a21a231f00bcab61649c538b796eed"),
    ("Apache-2.0", "apache license v2 0 ", 8300, "e6592cd2784eb676ffd10b315f25a623ba59fcaaf3dafb3e04d6db7c1e144db7"),
    ("Apache-2.0", "apache license v2 0 ", 8272, "943de69d3cccd0d2caac123dc7b861756bd9cd45c87b261878da7e128216f8d4"),
    ("Artistic-1.0", "artistic license pre", 5349, "01e99eb2b1b5c8e272a0b4b82fd94fb743acf9bff7233c4159c6c81b5ecbe5aa"),
    ("CC0-1.0", "creative commons leg", 6377, "a7bed473f9b907143e2aea7eae307ce91a6ff6898f380464b7096676ec52d79d"),
    ("GFDL-1.2", "gnu free documentati", 18275, "3cbdbc53d0cff07e47918f94ccff1fe1a80fbf39667a4ac20d94d006a48d32cc"),
    ("GFDL-1.3", "gnu free documentati", 20518, "5808f619c1710023841e59bc944804dc460e3b9f4022a304449d420b8a7dab0d"),
    ("GPL-1.0", "gnu general public l", 11107, "b6112ff76297f98f857a2b3fc2cfa00ce02147c88e2775c0e5972391cb273755"),
    ("GPL-2.0", "gnu general public l", 16119, "11a6df2696f2b0071647d9a251677960c39a7f0c0eef969a62c7017118c47e3a"),
    ("GPL-2.0", "gnu general public l", 13638, "677e55d8978d5244347b4b31351c3b3b4c4fffe3e5a67ff62688e6710dae3105"),
    ("GPL-2.0", "gnu general public l", 13610, "9c0c5a287e36efa4152e7f9324fb98877ff3365332c870cf2628862fceb4bf64"),
    ("GPL-3.0", "gnu general public l", 31432, "ac93470b431138df901e9981ac0e578f1986f2a3703129413f3031f105c42f31"),
    ("GPL-3.0", "gnu general public l", 29135, "ee9dfc5147fbb75c683669ea42147cd6979eea5450b49d4120cf925d78cda9ef"),
    ("GPL-3.0", "gnu general public l", 29107, "4f524ed904ea8a8b59c8571f0c82f9c5ed7fbef92acd9086c515417b0f4e8f98"),
    ("LGPL-2.0", "gnu library general ", 22387, "219e8e55e3e6063ff14994c39c9ed4843a3b7312219374afd2bf10ece90cd930"),
    ("LGPL-2.1", "gnu lesser general p", 23333, "b4fb1a012690f7b13f13ae5be43d832fa1c74993f46394e4d33e6b11643cbeca"),
    ("LGPL-3.0", "gnu lesser general p", 6505, "6454bcf2c861b36100529720ba9aa516a78695513289e6d86fcf8578fe26d81d"),
    ("MPL-1.1", "mozilla public licen", 21212, "58cead44daca3b3babbcabfefb4e62035250e5fabad112902e3454c23c1668e6"),
    ("MPL-2.0", "mozilla public licen", 13587, "224bb2c17d921bd4741e66abab35a6e0b95763e5ce868167167321f8bc083228"),
]
#: Fixed spellings: pattern and replacement, in this order, over lower-case text without punctuation.
SPELLINGS = [
    (r"\blicen[cs](e[sd]?|ing)\b", "licens$1"),
    (r"\bversion ([0-9])", "v$1"),
    (r"\bv ([0-9])", "v$1"),
    (r"\b(the|a|an) ", ""),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bshare alike\b", "sharealike"),
    (r"\bcopyright owners\b", "copyright holders"),
    (r"\bhttps\b", "http"),
]
PUNCTUATION = r"[\x00-\x20!-/:-@\[-`{-~\x{A0}\x{A9}\x{AB}\x{BB}\x{2010}-\x{201F}\x{2022}\x{2026}]+"
COPYRIGHT = r"(?m)^[\x20\t]*(?i:copyright|\(c\)|\x{A9}|all rights reserved)[^\n]*$"


#: Fixed words: every known text has one, and no spelling rule makes or changes them, so a text without any of them can't match.
ANCHORS = ["agplv3", "apache", "artistic", "bsd", "cc", "cc0", "creative", "gnu", "gpl", "gplv2", "gplv3", "isc", "lgplv3", "mit", "mozilla", "mpl", "permission", "redistribution", "unencumbered", "unlicense"]
_java = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p)
_COPYRIGHT, _PUNCTUATION = re.compile(_java(COPYRIGHT)), re.compile(_java(PUNCTUATION))
_SPELLINGS = [(re.compile(p, re.ASCII), to.replace("$1", r"\1")) for p, to in SPELLINGS]
_ANCHOR = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(ANCHORS)})(?![a-z0-9])")
BLANK_LINE = r"\r?\n[\x20\t]*\r?\n"
_BLANK_LINE = re.compile(BLANK_LINE)
#: Letters at the start of a known text by which its runs are looked for.
OPENING = 20


def canonical(text: str) -> str:
    """Normal form of one paragraph: without copyright lines, case, punctuation and variant spellings."""
    text = _PUNCTUATION.sub(" ", _COPYRIGHT.sub(" ", text).lower()).strip(" ")
    for pattern, to in _SPELLINGS:
        text = pattern.sub(to, text)
    return text


def paragraphs(text: str) -> list[str]:
    """Normal forms of the paragraphs, without empty ones; joined by blanks they are the normal form of the text."""
    return list(filter(None, map(canonical, _BLANK_LINE.split(text))))


def digest(normal: str) -> str:
    return hashlib.sha256(normal.encode("utf-8", "surrogatepass")).hexdigest()


def _notices() -> list[tuple[str, str]]:
    """(licence, text) of every notice with every name; a name of one word alone is no notice."""
    out = [(i, n.format(name)) for i, _, names in NAMES for name in names for n in NOTICES if n != "{}" or " " in canonical(name)]
    return out + [(i, f"the {name}") for i, _, names in NAMES for name in names if " " in canonical(name)]


def _texts() -> list[tuple[str, str]]:
    """(licence, text) of the fixed texts: alone, and below each of the licence's names as a title."""
    titles = {i: ["", *names, f"The {names[0]}", f"The {names[0]} ({i})"] for i, _, names in NAMES}
    return [(i, f"{title}\n\n{text}") for i, text in TEXTS.items() for title in titles[i]]


def known() -> list[tuple[str, str, bool]]:
    """(digest, licence, permissive): notices and fixed texts by rule, long texts by their fixed digests."""
    free = {i: p for i, p, _ in NAMES}
    out = {digest(" ".join(paragraphs(t))): i for i, t in _notices() + _texts()}
    out |= {d: i for i, _, _, d in FULL}
    return sorted((d, i, free[i]) for d, i in out.items())


def runs() -> dict[str, list[int]]:
    """Lengths of the known entire texts in normal form, by their openings."""
    out: dict[str, set[int]] = {}
    for normal in (" ".join(paragraphs(t)) for _, t in _texts()):
        out.setdefault(normal[:OPENING], set()).add(len(normal))
    for _, opening, length, _ in FULL:
        out.setdefault(opening, set()).add(length)
    return {k: sorted(v) for k, v in sorted(out.items())}


_RUNS: dict[str, list[int]] = {}


def units(text: str) -> list[tuple[int, str]]:
    """(kind, digest) of the texts in a document that may be licences: 0 the whole, 1 a line, a paragraph of several lines or a run of paragraphs."""
    may = lambda x: _ANCHOR.search(x.lower()) is not None
    if not may(text):
        return []
    if not _RUNS:
        _RUNS.update(runs())
    parts = paragraphs(text)
    whole = " ".join(parts)
    out = [(0, digest(whole)), *((1, digest(canonical(x))) for x in text.split("\n") if may(x))]
    out += [(1, digest(canonical(x))) for x in _BLANK_LINE.split(text) if "\n" in x.strip() and may(x)]
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    ends = {s - 1 for s in starts[1:]} | {len(whole)}
    after = dict(zip(starts, [*starts[1:], len(whole) + 1], strict=True))
    for s in starts:
        for length in _RUNS.get(whole[s : s + OPENING], ()):
            # A run of one paragraph is that paragraph.
            if s + length in ends and s + length >= after[s]:
                out.append((1, digest(whole[s : s + length])))
    return out


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, whole (licence of the entire text or null), licenses (sorted, comma-joined, empty if
    none), n_notices (lines, paragraphs and runs of paragraphs that match), restricted (a matching licence isn't permissive).

    A null text is empty; blank units match nothing; a paragraph of one line counts once. Line ends may be CRLF. Repeated rows are scanned each for
    itself. An empty table gives no rows. The digest table is fixed (under 2000 rows), so it is broadcast; only matches are shuffled.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known(), "digest string, license string, free boolean")
    named = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias(ROW), F.col(text_col).alias("text"))
    field = T.StructField("units", T._parse_datatype_string("array<struct<kind:int,digest:string>>"))
    work = lambda texts: [[[{"kind": k, "digest": d} for k, d in units(t)] for t in texts]]
    found = cut(map_texts(named, "text", ["id", ROW], [field], work))
    digest = found.select(ROW, F.explode("units").alias("u")).select(ROW, "u.*")
    hits = digest.join(F.broadcast(table), "digest").groupBy(ROW).agg(
        F.max(F.when(F.col("kind") == 0, F.col("license"))).alias("whole"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.count_if(F.col("kind") == 1).alias("n_notices"),
        F.bool_or(~F.col("free")).alias("restricted"),
    )
    out = found.select("id", ROW).join(cut(hits), ROW, "left")
    return out.select(
        F.col("id").alias(id_col),
        "whole",
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("restricted", F.lit(False)).alias("restricted"),
    )
