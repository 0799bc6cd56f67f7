"""Whole-text licence lookup by canonical digests.

A text is made canonical: lower case, copyright lines and reservations of
rights taken out, punctuation and runs of blanks made one blank, equivalent
spellings made one. The digest of what is left is hash-joined to the digests of
the known licences, a table of a few rows that is broadcast. Columns and words
of any other kind do not matter, so each document costs one pass.

Edge cases: a null text, or one in which nothing is left, has a null digest and
no licence; of known licences with equal digests the first name counts;
repeated rows are looked up each; a text of any length is read whole; ids are
not looked at, so that null and equal ones are like any other; no rows give no
rows; a new column whose name is in use gets underscores until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import free

COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*"
RESERVATION = r"all rights reserved\.?"
NOT_WORD = r"[^a-z0-9]+"
# Spellings that count as one; each is looked for between blanks.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("favour", "favor"), ("honour", "honor"),
    ("organisation", "organization"), ("recognise", "recognize"), ("per cent", "percent"), ("https", "http"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
)

# Texts of public licences, as their stewards publish them: fixed values.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
BSL = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = {
    "MIT": "MIT License\n" + MIT + WARRANTY,
    "MIT-untitled": MIT + WARRANTY,
    "ISC": "ISC License\n" + GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + AUTHOR,
    "ISC-untitled": GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + AUTHOR,
    "0BSD": GRANT + ".\n" + AUTHOR,
    "BSD-2-Clause": BSD_GRANT + BSD_END,
    "BSD-3-Clause": BSD_GRANT + BSD_NAMES + BSD_END,
    "Zlib": ZLIB,
    "Unlicense": UNLICENSE,
    "BSL-1.0": BSL,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}

# Digests of the canonical form of whole texts, as Debian has them in /usr/share/common-licenses.
DIGESTS = {
    "Apache-2.0": "59fc4bfd310bca26ce67a2ddcefeb4fe9694a70737d94908f69eeb6d0942dba2",
    "CC0-1.0": "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137",
    "GPL-2.0": "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61",
    "GPL-3.0": "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63",
    "LGPL-2.1": "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b",
    "LGPL-3.0": "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938",
    "MPL-1.1": "327a97374ad104383199744cb81e02d549b4aae5d048b7b0d6cd8299513ab0bc",
    "MPL-2.0": "a90ba5346ad1927fede05edb2d96afdd4948d68d16cef5d29e84239426134356",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text, between single blanks; null if nothing is left."""
    found = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n"), RESERVATION, " ")
    found = F.concat(F.lit(" "), F.trim(F.regexp_replace(found, NOT_WORD, " ")), F.lit(" "))
    for spelling, one in SPELLINGS:
        found = F.replace(found, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.when(F.length(F.trim(found)) > 0, found)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id) of the known texts: a few rows, one for each digest."""
    rows = spark.createDataFrame(sorted((KNOWN if texts is None else texts).items()), "license_id string, body string")
    found = rows.select(digest(F.col("body")).alias("digest"), "license_id")
    if texts is None:
        found = found.unionByName(spark.createDataFrame([(v, k) for k, v in sorted(DIGESTS.items())], "digest string, license_id string"))
    return found.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def find_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the digest of the canonical text and the licence it is, or null.

    The columns are ``digest`` and ``license_id``; one that ``docs`` has already
    gets underscores until its name is free.
    """
    digest_name = free("digest", docs.columns)
    id_name = free("license_id", [*docs.columns, digest_name])
    key = free("_known", [*docs.columns, digest_name, id_name])
    table = known.select(F.col("digest").alias(key), F.col("license_id").alias(id_name))
    found = docs.withColumn(digest_name, digest(F.col(text)))
    return found.join(F.broadcast(table), F.col(digest_name) == F.col(key), "left").drop(key)


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(column: str) -> str:
        found = f"regexp_replace(regexp_replace(lower({column}), {quote(COPYRIGHT_LINE)}, chr(10), 'g'), {quote(RESERVATION)}, ' ', 'g')"
        found = f"' ' || trim(regexp_replace({found}, {quote(NOT_WORD)}, ' ', 'g')) || ' '"
        for spelling, one in SPELLINGS:
            found = f"replace({found}, {quote(f' {spelling} ')}, {quote(f' {one} ')})"
        return found

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    return f"""WITH known AS (
  SELECT sha256(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {form("body")} AS c FROM (VALUES {values}) AS k(license_id, body)) WHERE trim(c) <> '' GROUP BY 1),
docs AS (SELECT doc_id, CASE WHEN trim(c) <> '' THEN sha256(c) END AS digest FROM (SELECT doc_id, {form("text")} AS c FROM {table}))
SELECT doc_id, docs.digest, license_id FROM docs LEFT JOIN known ON docs.digest = known.digest"""
