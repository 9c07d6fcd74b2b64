"""License scans by canonical digest.

A text is brought to a canonical form (lower case, equivalent spellings, copyright
lines out, punctuation and white space to single spaces) and the MD5 digest of the
whole form is hash-joined with the digests of known licences and notices. Each line
of a document is also held as a text of its own against the same digests, since
corpora carry notices as lines; that lookup needs no shuffle.

Definitions for odd input: a null or empty text, and one whose canonical form is
empty, has no digest and no licence; repeated rows are looked up each by itself;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tochi.llm.common import table

# Texts and notices of public licences, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""


def _bsd(clauses: int, numbered: bool) -> str:
    lines = [f"{k + 1}. {x}" if numbered else f"* {x}" for k, x in enumerate(_BSD_CONDITIONS[:clauses])]
    return "\n".join([_BSD_START, *lines, _BSD_END])


KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((f"BSD-{n}-Clause", title + _bsd(n, numbered)) for n in (2, 3) for numbered in (True, False) for title in ("", f"BSD {n}-Clause License\n")),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
)

# Digests of the canonical forms of long licences as their stewards
# publish them, and of the terms alone where an appendix follows them.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "d03e86ac7a1ff3f8d928e1d6027bfd17"),
    ("Apache-2.0", "2f973fce6821968caa77d834b80cee7c"),
    ("Apache-2.0", "a90697331248535821cbca3716b02146"),
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "49ffacd2fea52c0c124f0d16bc990c74"),
    ("GFDL-1.3", "2d7ce083c264cf7f093acc742260e501"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-1.0", "21fa8693acc5194a648fe02e11f65a72"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-2.0", "f2c06efe640b4a281cbe5337cdde80ab"),
    ("GPL-3.0", "b79359b5e391fd47146ff34ae3db7ec0"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("GPL-3.0", "17e434cc6db7003444b088cb4cc81e91"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.0", "97832943be1e344d51af5aee1b658e4f"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "4ed6600fcf5321eb9dcd2181cde18632"),
    ("MPL-2.0", "7d4b8b0889da3c01eff3fe431102e6d6"),
)

# Spellings that licence matching treats as equal.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("https:", "http:"),
)

#: A line that names a holder: it begins with a copyright sign, or with the word and
#: has a sign right behind it or a year; or it says that all rights are reserved.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©)[^\n]*|copyright[ \t][^\n]*[0-9]{4}[^\n]*|\(c\)[ \t]*[0-9]{4}[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: Runs of what is neither letter, digit nor line feed.
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that has one."""
    out = F.lower(text)
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), PUNCTUATION, " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_licenses(spark: SparkSession) -> DataFrame:
    """(digest, license) of the fixed list above, a few dozen rows."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    texts = rows.select(F.md5(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"), "license")
    return texts.unionByName(spark.createDataFrame(list(KNOWN_DIGESTS), "license string, digest string")).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license and line_licenses (sorted, comma-joined) per document.

    ``known`` holds (digest, license), one licence a digest; it is collected for the
    lines, so it must be a list of licences, not data that grows.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    listed = known.limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("more than 10,000 known digests: not a list of licences")
    by_digest = {r["digest"]: r["license"] for r in listed}
    rows = docs.select("doc_id", canonical_lines(F.col("text").cast("string")).alias("lines"))
    digest = F.when(F.size("lines") > 0, F.md5(F.array_join("lines", " ")))
    names = F.create_map(*[F.lit(x) for pair in sorted(by_digest.items()) for x in pair])
    hits = F.array_intersect(F.transform("lines", lambda x: F.md5(x)), F.array(*[F.lit(x) for x in sorted(by_digest)]))
    found = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: names[x]))), ",")
    rows = rows.select("doc_id", digest.alias("text_digest"), F.coalesce(found, F.lit("")).alias("line_licenses"))
    listed_df = docs.sparkSession.createDataFrame(sorted(by_digest.items()), "text_digest string, license string")
    return rows.join(F.broadcast(listed_df), "text_digest", "left").select("doc_id", "text_digest", "license", "line_licenses")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every whole text, and each of its lines, against the known digests."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_form(text: str) -> str:
    out = f"lower({text})"
    for other, one in SPELLINGS:
        out = f"replace({out}, '{other}', '{one}')"
    out = f"regexp_replace(regexp_replace({out}, '{COPYRIGHT_LINE}', '', 'g'), '{PUNCTUATION}', ' ', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _sql_known() -> str:
    rows = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in KNOWN)
    digests = ", ".join(f"('{name}', '{digest}')" for name, digest in KNOWN_DIGESTS)
    return f"SELECT md5(array_to_string({_sql_form('text')}, ' ')) AS digest, license FROM (VALUES {rows}) AS k(license, text) UNION SELECT digest, license FROM (VALUES {digests}) AS d(license, digest)"


ORACLE_SQL = f"""
WITH known AS ({_sql_known()}),
forms AS (SELECT row_number() OVER () AS r, doc_id, {_sql_form("text")} AS lines FROM documents),
hits AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS found
  FROM (SELECT r, unnest(lines) AS line FROM forms) JOIN known ON md5(line) = digest GROUP BY r)
SELECT doc_id, CASE WHEN len(lines) > 0 THEN md5(array_to_string(lines, ' ')) END AS text_digest, k.license, coalesce(h.found, '') AS line_licenses
FROM forms f LEFT JOIN hits h ON f.r = h.r
LEFT JOIN known k ON len(lines) > 0 AND md5(array_to_string(lines, ' ')) = k.digest
"""
