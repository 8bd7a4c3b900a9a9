"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought into a canonical form (ASCII letters in lower case, no copyright lines, equal spellings, no punctuation, single
spaces), and its SHA-256 is joined with the digests of known licences. Whole texts are looked up, and each line as well, for
notices within a text. Only equal canonical texts match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pliego.llm.common import text_or_empty
from pliego.llm.url_rules import LOWER, UPPER

# Licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"{_ISC}\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC}\n\n{_AS_IS}"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", f"{_ZERO_BSD}\n\n{_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_TAIL}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_NAME}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_NAME}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
]
SPELLINGS = [
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https", "http"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
]
COPYRIGHT = r"(^|\n)[ \t*#/]*(copyright|\(c\)|\x{A9})[ \t]*(\(c\)|\x{A9}|[0-9]|by[ \t])[^\n]*"
RESERVED = r"(^|\n)[ \t*#/]*all rights reserved[^\n]*"
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{2010}-\x{201F}\x{2022}\x{2026}]+"


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    for pattern in (COPYRIGHT, RESERVED):
        out = F.regexp_replace(out, pattern, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORDS, " "), F.lit(" "))
    for variant, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(out, "  +", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence), one row per distinct canonical text of the fixed list."""
    rows = spark.createDataFrame(KNOWN, "licence string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digest (of the canonical whole text), licence (of the whole text, or null), notices (licences of
    single lines, each once, sorted, comma-joined; empty if none).

    Null texts are read as empty; an empty canonical text is no licence. Very long texts are read whole, by one task. Texts
    equal to several known licences have the first by name. Repeated rows and rows without doc_id are returned each; other columns are ignored; an empty table gives no rows.
    """
    known = known_digests(docs.sparkSession)  # as many rows as the fixed list
    notices = F.create_map(*[F.lit(x) for r in known.collect() for x in (r.digest, r.licence)])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda line: F.try_element_at(notices, F.sha2(canonical(line), 256)))
    named = F.array_join(F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))), ",")
    found = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), named.alias("notices"))
    return found.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "licence", "notices")


def _canonical_sql(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({text}, {quoted(UPPER)}, {quoted(LOWER)})"
    for pattern in (COPYRIGHT, RESERVED):
        out = f"regexp_replace({out}, {quoted(pattern)}, chr(10), 'g')"
    out = f"(' ' || regexp_replace({out}, {quoted(NOT_WORDS)}, ' ', 'g') || ' ')"
    for variant, usual in SPELLINGS:
        out = f"replace({out}, ' {variant} ', ' {usual} ')"
    return f"trim(regexp_replace({out}, '  +', ' ', 'g'), ' ')"


def sql() -> str:
    """The DuckDB twin of ``scan`` over the table documents."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
    WITH known AS (
        SELECT sha256({_canonical_sql("text")}) AS digest, min(licence) AS licence
        FROM (VALUES {values}) AS k(licence, text) GROUP BY 1
    ), docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
    named AS (
        SELECT n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
        FROM lines JOIN known ON sha256({_canonical_sql("line")}) = digest GROUP BY n
    )
    SELECT doc_id, sha256({_canonical_sql("text")}) AS digest, licence, coalesce(notices, '') AS notices
    FROM docs LEFT JOIN named USING (n) LEFT JOIN known ON known.digest = sha256({_canonical_sql("text")})
    """
