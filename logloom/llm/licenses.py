"""Licence scan by canonical digests.

A text is normalised: lower case, copyright lines removed, equivalent
spellings unified, everything but letters and digits a single space.  The
digest of a whole normalised text is hash-joined to the digests of known
licence texts; each line is looked up in the same way, because notices stand
as lines in longer documents.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Most known texts: their digests stand in the plan as a constant.
MOST_KNOWN = 2000

#: Known licence texts and notices: (licence id, text).  Fixed values; the table is a bounded constant and may be broadcast.
KNOWN: list[tuple[str, str]] = [
    ("MIT", f"MIT License\n\n{_MIT_BODY}"),
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_NAMES}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}{_BSD_NAMES}{_BSD_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BOOST}"),
    ("BSL-1.0", _BOOST),
]

#: Rules for regular expressions that Java and RE2 read alike (fixed values); the code and the SQL both use these.
#: Lines that are copyright notices: a sign, a year or a place for one after the word, or rights reserved.  Sentences
#: wrapped before the word, and items (c) of a list, stay.
NOTICE_LINE = r"^[ \t]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|[\[<{])|\(c\)[ \t]*(?:copyright[ \t]*)?[0-9]{4}|©|all rights reserved[. \t\r]*\z)"
#: Paragraphs are notices, too, if each of their lines starts with the word.
PARAGRAPHS, COPYRIGHT, OTHER_LINE = r"\n(?:[ \t\r]*\n)+", r"(?:^|\n)[ \t]*copyright", r"^[ \t]*[^ \t\r]"
#: Rewrites in order.  A hyphen may end a line.
REWRITES: list[tuple[str, str]] = [
    (r"licenc(e|ed|es|ing|or)", "licens\\1"),
    (r"sub[ -][ \t\r\n]*licens", "sublicens"),
    (r"non[ -][ \t\r\n]*(infringement|commercial)", "non\\1"),
    (r"(organ|author|initial|recogn)is(e|ed|ing|ation)", "\\1iz\\2"),
    (r"[^\p{L}\p{N}\n]+", " "),
]

#: Digests of the canonical forms of long licences, as their publishers give them, and of those that end in "END OF TERMS AND
#: CONDITIONS" up to there; of a licence with several editions one digest each.
LONG: list[tuple[str, str]] = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def without_notices(text: Column) -> Column:
    """Lower-cased text without copyright notices."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(NOTICE_LINE), "").otherwise(x))

    def is_notice(p: Column) -> Column:
        return p.rlike(COPYRIGHT) & ~F.exists(F.split(p, "\n"), lambda x: x.rlike(OTHER_LINE) & ~x.rlike(COPYRIGHT))

    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), PARAGRAPHS), lambda p: ~is_notice(p))
    return F.when(text.rlike("copyright|\\(c\\)|©|all rights reserved"), F.array_join(paragraphs, "\n\n")).otherwise(text)


def normalised_lines(text: Column) -> Column:
    """Lower-cased, rewritten text without copyright notices, its line feeds kept."""
    out = without_notices(F.lower(text))
    for pattern, to in REWRITES:
        out = F.regexp_replace(out, pattern, to.replace("\\1", "$1").replace("\\2", "$2"))
    return out


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and digest of each known text, normalised like any other."""
    rows = spark.createDataFrame(known or KNOWN, "license_id string, text string").coalesce(1)
    return rows.select("license_id", F.sha2(canonical(normalised_lines(F.col("text"))), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of documents: doc_id, text_digest, license_id, n_notices, notice_ids.

    license_id is that of the known text which the whole text equals, else
    null; n_notices counts lines that equal a known text and notice_ids lists
    their licences once each, sorted, joined by commas.  A null text counts as
    empty; repeated rows each give a row; other columns are ignored; an empty
    table gives no rows.  Texts of any length are normalised and digested
    whole, inside their row.  ``known`` holds MOST_KNOWN texts at most.
    """
    if len(known or KNOWN) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    spark = documents.sparkSession
    table = digests(spark, known)
    if known is None:
        table = table.union(spark.createDataFrame(LONG, "license_id string, digest string").select("digest", "license_id").coalesce(1))
    found = {r["digest"]: r["license_id"] for r in table.collect()}  # as many rows as known texts
    lookup = F.create_map(*[F.lit(x) for kv in sorted(found.items()) for x in kv])
    longest = max(len(t) for _, t in known or KNOWN)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = docs.select("doc_id", normalised_lines(F.col("text")).alias("lines"))
    own = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) <= longest))
    ids = F.filter(F.transform(own, lambda x: F.try_element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
    scanned = lines.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("text_digest"), ids.alias("ids"))
    named = scanned.join(F.broadcast(table.withColumnRenamed("digest", "text_digest")), "text_digest", "left")
    return named.select("doc_id", "text_digest", "license_id", F.size("ids").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("ids")), ",").alias("notice_ids"))


def oracle_sql() -> str:
    """The same over DuckDB's view documents."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        kept = f"array_to_string(list_transform(string_split(lower({x}), chr(10)), lambda y: CASE WHEN regexp_matches(y, {q(NOTICE_LINE)}) THEN '' ELSE y END), chr(10))"
        others = f"len(list_filter(string_split(p, chr(10)), lambda y: regexp_matches(y, {q(OTHER_LINE)}) AND NOT regexp_matches(y, {q(COPYRIGHT)})))"
        notice = f"(regexp_matches(p, {q(COPYRIGHT)}) AND {others} = 0)"
        x = f"array_to_string(list_filter(string_split_regex({kept}, {q(PARAGRAPHS)}), lambda p: NOT {notice}), chr(10) || chr(10))"
        for pattern, to in REWRITES:
            x = f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"
        return x

    whole = "sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g')))"
    rows = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    long = ", ".join(f"({q(i)}, {q(d)})" for i, d in LONG)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT license_id, {whole} AS digest FROM (SELECT license_id, {lines("text")} AS lines FROM (VALUES {rows}) AS v(license_id, text)) UNION ALL FROM (VALUES {long}) AS v(license_id, digest))
  GROUP BY digest),
docs AS (SELECT row_number() OVER () AS n, doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
parts AS (SELECT n, unnest(string_split(lines, chr(10))) AS line FROM docs),
notices AS (
  SELECT n, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids
  FROM parts JOIN known ON sha256(trim(line)) = digest WHERE trim(line) <> '' GROUP BY n)
SELECT doc_id, text_digest, license_id, coalesce(n_notices, 0) AS n_notices, coalesce(notice_ids, '') AS notice_ids
FROM (SELECT n, doc_id, {whole} AS text_digest FROM docs) LEFT JOIN known ON text_digest = digest LEFT JOIN notices USING (n)"""
