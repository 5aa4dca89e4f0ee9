"""Licence scans by digests of canonical texts.

A text is brought to a canonical form: lower case, copyright statements and
titles out (whole lines that say no more), equivalent spellings made one,
everything but letters and digits a single space.  The digest of the whole canonical text is hash-joined with the digests
of known licence texts.  Each line of a text is looked up whole in the same way,
which finds the notices that authors put into a text.

Null and empty texts have the digest of the empty text, which no licence has.
Rows that repeat keep their own results; other columns are ignored.  DataFrame
functions only; the known texts are broadcast while there are at most
``BROADCAST_ROWS`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence texts (a digest and a name each) that are broadcast.
BROADCAST_ROWS = 100_000

#: Spellings that count as the same, after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("non-commercial", "noncommercial"),
    ("percent", "per cent"),
    ("judgement", "judgment"),
    ("programme", "program"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("wilful", "willful"),
    ("https://", "http://"),
    ("&", " and "),
)

#: Fixed values, public texts: full licences that are short, and the usual one-line notices.  ``scan`` takes any other table of names and texts.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


#: Lines that only say whose work it is: the word and then a year, a sign or "by"; or a sign and then a year.
_OWNER = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|&copy;|<|\[|[0-9]{4}|by )[^\n]*|(\(c\)|©|&copy;)[ \t]*[0-9]{4}[^\n]*|all rights reserved\.?[ \t\r]*)"
#: Lines that only name a licence.
_TITLE = r"(^|\n)[ \t*#/;-]*(the )?(mit|isc|zlib|zlib/libpng|unlicense|apache|bsd|0bsd|bsd[ -](zero|[0-4])[ -]clause( [\"']?(simplified|new|revised)[\"']?( or [\"']?(revised|freebsd)[\"']?)?)?) licen[sc]e( \((mit|isc|zlib|0bsd|x11)\)|,? version 2\.0)?:?[ \t\r]*(\n|$)"


def _canonical_lines(text: str | Column) -> Column:
    """The canonical form of a text, line by line: words and single spaces."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, _TITLE, "\n")
    out = F.regexp_replace(out, _OWNER, "\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical(text: str | Column) -> Column:
    """The canonical form of a text; empty for a null."""
    return F.btrim(F.regexp_replace(_canonical_lines(text), r"[ \n]+", " "))


def digest(text: str | Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """The known texts as rows (name, text)."""
    return spark.createDataFrame(list(KNOWN), "name string, text string")


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, digest, license (of the whole text, or null), n_notices, notices.

    ``n_notices`` counts the lines that are known texts; ``notices`` are their
    names, sorted and joined by commas, or null.
    """
    known = licenses.groupBy(digest("text").alias("digest")).agg(F.min("name").alias("name")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    known = F.broadcast(known) if licenses.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = rows.select(F.md5(F.col("text").cast("binary")).alias("k"), F.explode(F.split(_canonical_lines("text"), "\n")).alias("line"))
    lines = lines.select("k", F.btrim("line").alias("line")).where("line <> ''")
    found = lines.select("k", F.sha2("line", 256).alias("digest")).join(known, "digest")
    found = found.groupBy("k", "name").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("k").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))
    copies = rows.select(F.md5(F.col("text").cast("binary")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    found = found.join(copies, "k").select("k", (F.col("n") / F.col("copies")).cast("long").alias("n_notices"), "notices")
    whole = rows.select("id", F.md5(F.col("text").cast("binary")).alias("k"), digest("text").alias("digest")).join(known.withColumnRenamed("name", "license"), "digest", "left")
    out = whole.join(found, "k", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "notices")


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern in (_TITLE, _OWNER):
        out = "regexp_replace({}, '{}', chr(10), 'g')".format(out, pattern.replace("'", "''"))
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"


def _sql() -> str:
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""WITH known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(name) AS name FROM (VALUES {known}) AS k(name, text) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    n AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT name)), ',') AS notices
      FROM lines JOIN known ON sha256({_sql_canonical("line")}) = digest WHERE line <> '' GROUP BY doc_id),
    d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
    SELECT doc_id, digest, name AS license, coalesce(n_notices, 0) AS n_notices, notices
    FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)"""


#: The rows of ``scan`` over the table documents with the known licences.
SQL = _sql()
