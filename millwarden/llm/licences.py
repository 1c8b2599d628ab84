"""Licence scan: canonical digests of entire texts, hash-joined to those of known licences and notices.

A text is made canonical: A-Z lower-cased, lines of copyright dropped, equivalent spellings made one, punctuation and white
space made single spaces.  Its digest, and that of each of its lines, is joined to the digests of the known texts.

Defined results: null and empty texts match nothing; rows of a repeated key are counted together; a known text whose canonical
form is empty is left out, known texts that become equal all match; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known rows up to which the digests are broadcast.
BROADCAST_ROWS = 100_000

#: Spellings taken for one another, the first for the second.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("organisation", "organization"),
             ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("whilst", "while"),
             ("wilful", "willful"), ("favour", "favor"), ("https", "http"), ("copyright owner", "copyright holder"), ("v 2", "version 2"), ("v 3", "version 3"))

#: Public licence texts and the notices in use for them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
             "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC = tuple((f"CC-{kind}-{version}", f"{lead} {form}.") for kind, name in _CC_KINDS.items() for version in ("4.0", "3.0", "2.0")
            for lead in ("Licensed under", "Released under", "This work is licensed under", "This text is licensed under")
            for form in (*(f"{the}CC {kind} {v}{end}" for the, end in (("", ""), ("the ", " license"), ("a ", " license")) for v in (version, f"v{version}", f"version {version}")),
                         f"a Creative Commons {name} {version} {'International' if version == '4.0' else 'Unported' if version == '3.0' else 'Generic'} License"))
KNOWN = tuple(dict.fromkeys((
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Apache-2.0", _APACHE_HEADER), *_CC,
)))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(^|\n)[^a-z\n]*(copyright( |:|$|\n)|\(c\)|©|all rights reserved)[^\n]*"
SIGNS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\u2010-\u2015\u2018-\u201F\u00A0]+"


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines of a text that are not empty."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, "$1"), SIGNS, " ")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return F.filter(F.transform(F.split(out, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "licence string, text string")


def scan_licences(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per key, licence and scope (whole ``text`` or a ``line``): in how many places the licence stands."""
    digests = known.select(F.col("licence"), F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"), F.array_join(canonical_lines(F.col("text")), " ").alias("form"))
    digests = digests.filter("form != ''").select("licence", "digest").distinct()
    small = digests.count() <= BROADCAST_ROWS
    lines = docs.select(F.col(key).alias("key"), canonical_lines(F.col(text)).alias("lines"))
    units = F.concat(F.array(F.struct(F.lit("text").alias("scope"), F.array_join("lines", " ").alias("form"))),
                     F.transform("lines", lambda line: F.struct(F.lit("line").alias("scope"), line.alias("form"))))
    placed = lines.filter(F.size("lines") > 0).select("key", F.explode(units).alias("u")).select("key", "u.scope", F.sha2("u.form", 256).alias("digest"))
    found = placed.join(F.broadcast(digests) if small else digests, "digest")
    return found.groupBy(F.col("key").alias(key), "licence", "scope").agg(F.count("*").alias("places"))


def oracle() -> str:
    """DuckDB SQL over ``documents``."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    body = f"regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '\\1', 'g'), '{_re2(SIGNS)}', ' ', 'g')"
    for old, new in SPELLINGS:
        body = f"regexp_replace({body}, '\\b{old}\\b', '{new}', 'g')"
    lines = f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"""
WITH known(licence, text) AS (VALUES {quoted}),
digests AS (SELECT DISTINCT licence, array_to_string({lines}, ' ') AS form FROM known),
docs AS (SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM documents),
units AS (SELECT doc_id, 'text' AS scope, array_to_string(lines, ' ') AS form FROM docs UNION ALL SELECT doc_id, 'line', unnest(lines) FROM docs)
SELECT doc_id, licence, scope, count(*) AS places FROM units JOIN digests USING (form) WHERE form <> '' GROUP BY ALL"""


def _re2(pattern: str) -> str:
    """Code points as the other engine writes them."""
    import re

    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)
