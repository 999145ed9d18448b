"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form - lower case, copyright lines removed,
equivalent spellings unified, everything but ASCII letters and digits reduced to
single spaces, so that it does not depend on how lines are wrapped - and the SHA-256 of the *entire* form is looked up in a table of
digests of known licence texts. The same is done for each distinct line, against
known one-line notices, so that a grant inside a longer file is reported too.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import column

_HERE = Path(__file__).parent

#: Lines that start so carry names and years, which differ between copies: "copyright"
#: followed by a sign, a year, a name's lead-in or a blank to fill in. A line of prose that
#: happens to begin with the word, as the text was wrapped, is none.
COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9]{4}|by |year|yyyy|name of|the [^\n]{0,60}(?:authors|contributors))"
    r"|©|\(c\)[^a-z0-9\n]*(?:[0-9]{4}|copyright))[^\n]*$"
)

#: Equivalent spellings, applied in this order to lower-case text (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("&", " and "),
    ("https://", "http://"),
)
#: Equivalent words, applied to the words with a space before and after each (fixed values).
WORDS = (
    (" sub license", " sublicense"),
    (" per cent ", " percent "),
    (" all rights reserved ", " "),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

def _whole_texts() -> dict[str, tuple[str, ...]]:
    """Every file of ``licence_texts`` (ID.txt or ID.VARIANT.txt), with and without what
    follows its terms, besides the short texts above, each with its usual titles."""
    out: dict[str, list[str]] = {
        "MIT": [_MIT, "MIT License\n" + _MIT, "The MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT],
        "ISC": [_ISC, "ISC License\n" + _ISC, "The ISC License\n" + _ISC],
        "Apache-2.0": [_APACHE_HEADER],
        "Zlib": [_ZLIB, "zlib License\n" + _ZLIB, "The zlib License\n" + _ZLIB],
    }
    for path in sorted((_HERE / "licence_texts").glob("*.txt")):
        name = path.name.removesuffix(".txt").removesuffix(".spdx")
        body = path.read_text(encoding="utf-8")
        forms = out.setdefault(name, [])
        forms.append(body)
        end = body.find(_END)
        if end >= 0:
            forms += [body[:end], body[: end + len(_END)]]
        forms += [f"{title}\n{body}" for title in _TITLES.get(name, ())]
    return {name: tuple(dict.fromkeys(forms)) for name, forms in out.items()}


_END = "END OF TERMS AND CONDITIONS"
_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International",),
}

#: Whole licence texts, by name (public texts, fixed values).
KNOWN_TEXTS: dict[str, tuple[str, ...]] = _whole_texts()

#: How a notice begins; a name of a licence follows.
_VERBS = ("licensed", "released", "distributed", "available")
_SUBJECTS = ("", *(f"this {x} is " for x in ("work", "software", "program", "project", "file", "document", "code", "content")))
_LEADS = (
    *(f"{subject}{verb} under " for subject in _SUBJECTS for verb in _VERBS),
    *(f"{subject}{verb} under the terms of " for subject in _SUBJECTS[:4] for verb in _VERBS[:3]),
)


def _gnu(short: str, full: str, version: str) -> dict[str, tuple[str, ...]]:
    """Names of a GNU licence; without 'or later' the very version."""
    major = version.removesuffix(".0")
    forms = [f"the {full}, version {v}" for v in dict.fromkeys((major, version))]
    forms += [f"the {full} v{v}" for v in dict.fromkeys((major, version))]
    forms += [f"the {short}v{major}", f"the {short} v{major}", f"{short}-{version}", f"{short}v{major}"]
    later = [f"the {full}, version {major} or later", f"the {full}, version {major}, or (at your option) any later version", f"the {full} v{major} or later"]
    return {f"{short}-{version}": tuple(forms), f"{short}-{version}-or-later": (*later, f"{short}-{version}-or-later")}


_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _creative_commons(kind: str, version: str) -> tuple[str, ...]:
    area = "International" if version == "4.0" else "Unported"
    short, full = f"CC {kind} {version}", f"Creative Commons {_CC[kind]} {version}"
    forms = (short, f"{full} {area} license", f"a {full} {area} license", f"the {full} {area} license")
    return forms if version == "3.0" else (*forms, f"the {short} license", f"the {full} license", f"Creative Commons {kind} {version}")


def _names() -> dict[str, tuple[str, ...]]:
    """The names by which notices call a licence, in all their usual forms."""
    out: dict[str, tuple[str, ...]] = {
        "MIT": ("the MIT license", "MIT license", "MIT", "an MIT license", "the MIT license (MIT)"),
        "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license", "Apache License 2.0", "Apache 2.0", "Apache License, Version 2.0", "the Apache 2 license", "the Apache License v2.0"),
        "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "BSD 2-Clause", "the Simplified BSD License"),
        "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "BSD 3-Clause", "the New BSD License", "the Modified BSD License", "a BSD 3-Clause License"),
        "0BSD": ("the Zero-Clause BSD License", "the BSD Zero Clause License", "0BSD"),
        "ISC": ("the ISC License", "ISC"),
        "Zlib": ("the zlib License", "zlib"),
        "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0", "the Boost Software License"),
        "MPL-1.1": ("the Mozilla Public License, Version 1.1", "the Mozilla Public License 1.1", "the MPL 1.1"),
        "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"),
        "EPL-1.0": ("the Eclipse Public License, Version 1.0", "the Eclipse Public License 1.0", "the Eclipse Public License v1.0"),
        "EPL-2.0": ("the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0"),
        "CDDL-1.0": ("the Common Development and Distribution License, Version 1.0", "the CDDL 1.0"),
        "EUPL-1.2": ("the European Union Public Licence, Version 1.2", "the EUPL 1.2", "the EUPL v1.2"),
        "Artistic-2.0": ("the Artistic License 2.0", "the Artistic License, Version 2.0"),
        "Unlicense": ("the Unlicense",),
        "WTFPL": ("the WTFPL",),
        "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "the CC0 1.0 Universal license", "the Creative Commons CC0 1.0 Universal license"),
        "OFL-1.1": ("the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1"),
        "GFDL-1.2": ("the GNU Free Documentation License, Version 1.2",),
        "GFDL-1.3": ("the GNU Free Documentation License, Version 1.3", "the GNU Free Documentation License 1.3"),
        "ODbL-1.0": ("the Open Database License", "the Open Database License (ODbL) v1.0", "the ODbL"),
    }
    for short, full, versions in (
        ("GPL", "GNU General Public License", ("2.0", "3.0")),
        ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
        ("AGPL", "GNU Affero General Public License", ("3.0",)),
    ):
        for version in versions:
            out.update(_gnu(short, full, version))
    out["CC-BY-4.0"] = ("a Creative Commons Attribution 4.0 International License",)
    for kind in _CC:
        for version in ("4.0", "3.0"):
            out[f"CC-{kind}-{version}"] = _creative_commons(kind, version)
    return out


#: Notices that don't name the licence after a lead-in.
_SENTENCES = {
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("SPDX-License-Identifier: CC-BY-4.0",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
}


def _all_notices() -> dict[str, tuple[str, ...]]:
    """Every name after every lead-in, and the SPDX tag of every id of the public list."""
    out = {name: [lead + form for lead in _LEADS for form in forms] for name, forms in _names().items()}
    for name, lines in _SENTENCES.items():
        out.setdefault(name, []).extend(lines)
    for spdx in (_HERE / "spdx_ids.txt").read_text(encoding="ascii").split():
        if spdx.endswith("+"):
            continue  # its canonical form is that of the id without the plus
        name = spdx.removesuffix("-only")  # GPL-3.0 and GPL-3.0-only are one
        out.setdefault(name, []).append(f"SPDX-License-Identifier: {spdx}")
    return {name: tuple(dict.fromkeys(lines)) for name, lines in out.items()}


#: One-line notices, by name (fixed values).
KNOWN_NOTICES: dict[str, tuple[str, ...]] = _all_notices()

#: The tables of known digests are broadcast; they may have so many rows at most.
MAX_KNOWN = 10_000


def _canonical_lines(text: Column) -> Column:
    """The text whose lines, trimmed, are the canonical forms of its lines."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.regexp_replace(out, r"[^a-z0-9\n]+", " ")


def _unified(words: Column) -> Column:
    """Words between single spaces, with equivalent ones made one."""
    out = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for word, one in WORDS:
        out = F.replace(out, F.lit(word), F.lit(one))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """The canonical form; null stays null, a text without letters or digits is ''."""
    return _unified(F.regexp_replace(_canonical_lines(text), r"[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(license, known_digest), one row per distinct canonical form."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts, got {len(rows)}")
    columns = {"license": [name for name, _ in rows], "body": [text for _, text in rows]}
    table = spark.createDataFrame(pa.table(columns, pa.schema({"license": pa.string(), "body": pa.string()})))
    return table.groupBy(digest(F.col("body")).alias("known_digest")).agg(
        F.min("license").alias("license"), F.min(canonical(F.col("body"))).alias("form")
    )


def scan_licenses(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    known: Mapping[str, tuple[str, ...]] | None = None,
    notices: Mapping[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per document: key, n_canonical_chars, text_digest, license, notices.

    ``license`` names the licence whose text the whole document is, else null.
    ``notices`` lists, sorted and without repeats, the licences whose notice is a
    line of it. Null text: null digest and license, no notices. Repeated rows each
    get a row. The known digests (bounded by ``MAX_KNOWN``) are broadcast, so a
    digest shared by a third of all rows moves nothing.
    """
    spark = docs.sparkSession
    texts = known_digests(spark, KNOWN_TEXTS if known is None else known).drop("form")
    # at most MAX_KNOWN rows; they become one constant, so that no row carries them
    lines = known_digests(spark, KNOWN_NOTICES if notices is None else notices).filter("form <> ''").collect()
    by_prefix: dict[str, dict[str, str]] = {}
    for r in lines:
        by_prefix.setdefault(r["known_digest"][:2], {})[r["known_digest"]] = r["license"]
    table = F.from_json(F.lit(json.dumps(by_prefix)), "map<string,map<string,string>>")
    longest = max((len(r["form"]) for r in lines), default=0)
    first_words = sorted({r["form"].split(" ", 1)[0] for r in lines})

    def name_of(form: Column) -> Column:
        key = F.sha2(form, 256)
        return F.element_at(F.element_at(table, F.substring(key, 1, 2)), key)

    # no notice is longer or begins otherwise, so nothing is lost
    forms = F.transform(F.split(F.col("lines"), "\n"), _unified)
    candidate = F.filter(
        forms, lambda x: (F.char_length(x) <= longest) & F.substring_index(x, " ", 1).isin(first_words)
    )
    found = F.array_sort(
        F.array_distinct(F.filter(F.transform(candidate, name_of), lambda x: x.isNotNull()))
    )
    base = docs.select(column(key).alias("key"), _canonical_lines(column(text)).alias("lines"))
    base = base.withColumn("form", _unified(F.regexp_replace("lines", r"[^a-z0-9]+", " ")))
    scanned = base.select(
        "key",
        F.char_length("form").cast("long").alias("n_canonical_chars"),
        F.sha2("form", 256).alias("text_digest"),
        F.coalesce(found, F.array().cast("array<string>")).alias("notices"),
    )
    hit = scanned.join(F.broadcast(texts), F.col("text_digest") == F.col("known_digest"), "left")
    return hit.select(F.col("key").alias(key), "n_canonical_chars", "text_digest", "license", "notices")
