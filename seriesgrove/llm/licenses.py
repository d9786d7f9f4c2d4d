"""Operator 1: licence scan by canonical digest lookup.

A unit is a whole document, or one of its lines; units are canonicalised (case,
punctuation, copyright lines, equivalent spellings), digested whole with
SHA-256, and hash-joined to the digests of known licence texts, which go
through the same steps.  A text is normalised once, by byte operations in Arrow
batches.  The known table has one row per text in ``KNOWN``, per whole licence in
``license_texts`` (with and without its title and its appendix) and per title of
the short licences in ``KNOWN``, plus those the caller adds; its digests are stored, broadcast up to a
size in bytes (``common.BROADCAST_BYTES``) and joined by shuffle beyond.

Defined cases: null text is an empty unit and matches nothing; units that
canonicalise to nothing match nothing; a document may match several licences
and then has one row for each (unit, licence), counted; repeated rows of the
same doc_id add up; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table

#: Published licence texts and standard notices (SPDX identifier, text).
KNOWN: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)

#: Whole licences, a file each, named by SPDX identifier.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
#: What ends the terms; instructions follow.  The MPL's exhibits belong to its terms.
TERMS_END = re.compile(r"^[ ]*(END OF TERMS AND CONDITIONS|ADDENDUM: How to use).*", re.M | re.S)
#: Titles that whole licences in ``KNOWN`` bear; the MIT text there begins with the first.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "Zlib": ("zlib License", "The zlib License", "zlib License (Zlib)", "The zlib/libpng License"),
}

#: Spellings that count as the same (whole words after lower-casing).
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("copyright owner", "copyright holder"),
)
COPYRIGHT = r"(^|\n)[^\na-z0-9]*(copyright|\(c\))[^\n]*|(^|\n)[^\n]*all rights reserved[^\n]*"
#: What a text must hold for ``COPYRIGHT`` to match.
MARKS = (b"copyright", b"(c)", b"all rights reserved")
#: Characters beyond ASCII that count as white space, beside the copyright sign.
BEYOND = "“”‘’–—\u00a0\u00ab\u00bb\u00b7\u2010\u2011\u201a\u201e\u2022\u2026\u202f\u2039\u203a\u3000\ufeff"
SPACES = tuple(c.encode() for c in "©" + BEYOND)
#: A line that starts with the copyright sign is a copyright line too.
SIGNED = rb"(^|\n)[^\na-z0-9]*?" + SPACES[0] + rb"[^\n]*"
#: ASCII other than letters, digits and the newline becomes a space; bytes.lower() has done the letters.
TABLE = bytes(i if i >= 128 or i == 10 or chr(i).isalnum() else 32 for i in range(256))
PADDED = tuple((f" {a} ".encode(), f" {b} ".encode()) for a, b in SPELLINGS)
OUT = "unit string, digest binary, n long"


def _spelled(padded: bytes) -> bytes:
    for _ in range(2):  # neighbours share a space, so every other one is left for the second time
        before = padded
        for a, b in PADDED:
            padded = padded.replace(a, b)
        if padded == before:
            break
    return padded


def canonical(text: str | None, units: str = "text") -> tuple[bytes, list[bytes]]:
    """The canonical forms of a text and of its lines: words a-z0-9 and other letters, one space between.

    Copyright lines and punctuation go once; the lines and the whole text are
    both made from what is left.  ``units`` as in ``scan``.
    """
    plain = (text or "").encode("utf-8", "surrogatepass").lower()
    if SPACES[0] in plain:
        plain = re.sub(SIGNED, b"\n", plain).replace(SPACES[0], b" ")
    if any(m in plain for m in MARKS):
        plain = re.sub(COPYRIGHT.encode(), b"\n", plain)
    plain = plain.translate(TABLE)
    if not plain.isascii():
        for c in SPACES[1:]:
            plain = plain.replace(c, b" ")
    whole, lines = b"", []
    if units != "line":
        whole = _spelled(b" " + b" ".join(plain.split()) + b" ").strip()
    if units != "text":
        # A newline between the padded lines keeps spellings from reaching across.
        padded = b"\n".join(b" " + b" ".join(x.split()) + b" " for x in plain.split(b"\n"))
        lines = [x.strip() for x in _spelled(padded).split(b"\n")]
    return whole, lines


def unit_digests(rows: DataFrame, units: str) -> DataFrame:
    """``rows`` of (id, text) as (id, unit, digest, n): the distinct non-empty units of each row and how often they occur."""
    name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kind, digest, n = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                whole, lines = canonical(text.as_py(), units)
                found = Counter(("line", x) for x in lines if x)
                if whole:
                    found["text", whole] = 1
                for (unit, c), k in found.items():
                    at.append(i)
                    kind.append(unit)
                    digest.append(hashlib.sha256(c).digest())
                    n.append(k)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kind, pa.string()), pa.array(digest, pa.binary()), pa.array(n, pa.int64())], names=[name, "unit", "digest", "n"])

    return rows.mapInArrow(run, f"`{name}` {rows.schema[0].dataType.simpleString()}, {OUT}")


def digests(known: DataFrame) -> DataFrame:
    """(license, digest) of known (license, text)."""
    return unit_digests(known.select("license", "text"), "text").select("license", "digest").distinct()


def scan(docs: DataFrame, known: DataFrame, units: str = "both") -> DataFrame:
    """(doc_id, unit, license, n_units): units equal to a known text.  units: text, line or both."""
    table_ = small(stored(docs.sparkSession, digests(known), "digests"))
    rows = unit_digests(docs.select("doc_id", "text"), units)
    return rows.join(table_, "digest").groupBy("doc_id", "unit", "license").agg(F.sum("n").alias("n_units"))


def whole_texts() -> list[tuple[str, str]]:
    """Whole licences under each title and without one; those in files with and without what follows the terms."""
    out = []
    for name, text in KNOWN:
        if name in TITLES and len(text) > 200:
            bare = text.removeprefix(TITLES[name][0]).strip()
            out += [(name, bare), *((name, f"{title}\n{bare}") for title in TITLES[name])]
    for file in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, file), encoding="utf-8") as f:
            text = f.read().strip()
        for t in (text, TERMS_END.sub("", text), re.sub(r"(?m)^([ ]*END OF TERMS AND CONDITIONS).*", r"\1", text, flags=re.S)):
            out += [(file.removesuffix(".txt"), t), (file.removesuffix(".txt"), re.split(r"\n[ ]*\n", t, maxsplit=1)[1])]
    return list(dict.fromkeys(out))


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *whole_texts()], "license string, text string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_texts(spark))


def _sql_canonical(c: str) -> str:
    c = f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ©', 'abcdefghijklmnopqrstuvwxyz ')"
    c = f"regexp_replace({c}, '{COPYRIGHT}', chr(10), 'g')"
    c = rf"' ' || trim(regexp_replace({c}, '[\x00-\x2F\x3A-\x60\x7B-\x7F{BEYOND}]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS * 2:
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"trim({c})"


def _oracle() -> str:
    known = ",\n  ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return rf"""
WITH k0(license, text) AS (VALUES {known}),
k AS (SELECT DISTINCT license, sha256({_sql_canonical("text")}) AS digest FROM k0),
u AS (SELECT doc_id, 'text' AS unit, text AS u FROM documents
      UNION ALL SELECT doc_id, 'line', unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
d AS (SELECT doc_id, unit, {_sql_canonical("u")} AS c FROM u)
SELECT doc_id, unit, license, count(*) AS n_units FROM d JOIN k ON sha256(d.c) = k.digest WHERE c <> '' GROUP BY ALL"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": _oracle()}
