r"""Licence scan: digests of whole, canonical texts joined to those of known licences.

Canonical form, by built-in functions only: line ends unified; A-Z lower-cased;
copyright lines removed (a line that opens, after signs, with a copyright mark
followed by a year, a placeholder or "by", or with the copyright sign; of a line
that goes on with a licence's own first words those stay); all
ASCII signs and the usual typographic quotes, dashes and bullets become one
space; equivalent spellings are mapped to one (-ise and -ize, -our and -or,
licence and license, sub license and sublicense, owner and holder, per cent and
percent, https and http, and so on); "all rights reserved" is dropped.

The catalogue is joined by SHA-256.  The built-in one is a fixed table of digests
(LICENSE files with and without titles, numbered or bulleted, and full texts; see
:mod:`epiframe.llm.license_variants`) and is broadcast; another catalogue is joined as Spark's statistics say.  A
document is one row in and one row out, for each licence with its digest; null
and empty texts have the digest of the empty string and no licence.  Texts are
digested whole; nothing is shuffled with the built-in catalogue.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.staging import Carried

#: Short licence texts and notices as their stewards publish them.
LICENSES = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>'),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
]

#: Digests of all known forms of licences, those above and of :mod:`epiframe.llm.license_variants`.
TABLE = Path(__file__).parent / "license_digests.csv"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic signs that count as punctuation.
_SIGNS = " ©«®·»‐‑‒–—―‘’‚“”„•…™"
#: Words with which a licence's own text begins, on the line of a copyright statement too.
_OPENINGS = "permission is hereby granted|permission to use|redistribution and use|this software is provided|this is free and unencumbered|licensed under the"
#: A copyright statement, up to a licence's own words (kept) or the end of its line.
_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]|\[|<|\{|by )|©|\(c\)[ \t]*([0-9]|copyright))([^\n]*?(" + _OPENINGS + r")|[^\n]*)"
_PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: (pattern, replacement) over canonical words, each followed by a space; $n stands for a group.
_SPELLINGS = [
    (r"([a-z]{3})is(e|ed|es|er|ers|ing|ation|ations) ", "$1iz$2 "),
    (r"([a-z]{2})our(s|ed|able|ably)? ", "$1or$2 "),
    (r"(lic|off|def)enc(e|ed|es|ee|ees|ing) ", "$1ens$2 "),
    (r"(judg|acknowledg)ement", "$1ment"),
    (r"(anal|catal)ogue", "$1og"),
    (r" sub licens", " sublicens"),
    (r" copyright owner", " copyright holder"),
    (r" per cent ", " percent "),
    (r" https ", " http "),
    (r" non commercial", " noncommercial"),
    (r" all rights reserved ", " "),
]


def canonical(text: Column) -> Column:
    """The canonical form of a whole text; null counts as empty."""
    c = F.translate(F.coalesce(text, F.lit("")), "\r" + _UPPER, "\n" + _LOWER)
    c = F.regexp_replace(c, _COPYRIGHT, "\n$6")
    c = F.translate(c, _SIGNS, " " * len(_SIGNS))
    c = F.concat(F.lit(" "), F.regexp_replace(c, _PUNCTUATION, " "), F.lit(" "))
    for pattern, by in _SPELLINGS:
        c = F.regexp_replace(c, pattern, by)
    return F.trim(F.regexp_replace(c, " +", " "))


def catalogue(spark: SparkSession) -> DataFrame:
    """(license_id, license_digest) of the built-in licences' short texts."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in LICENSES)))
    known = spark.range(1).select(rows.alias("l")).select("l.license_id", F.sha2(canonical(F.col("l.text")), 256).alias("license_digest"))
    return F.broadcast(known)


def known_forms(spark: SparkSession) -> DataFrame:
    """(license_id, license_digest) of every form of the built-in licences: titled, bulleted and full texts as well."""
    lines = [" ".join(x) for x in _forms()]
    lines = spark.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("line"))
    return F.broadcast(lines.select(F.split("line", " ")[0].alias("license_id"), F.split("line", " ")[1].alias("license_digest")))


def _forms() -> list[tuple[str, str]]:
    with TABLE.open(newline="") as f:
        return [(r["license_id"], r["license_digest"]) for r in csv.DictReader(f)]


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_digest`` and ``_license`` (null: none known)."""
    known = known_forms(docs.sparkSession) if known is None else known
    known = known.select(F.col("license_digest").alias("_known"), F.col("license_id").alias("_license"))
    carried = Carried(docs, "_digest", "_license")
    out = docs.select(carried.column, F.sha2(canonical(F.col(text_col)), 256).alias("_digest"))
    return out.join(known, F.col("_digest") == F.col("_known"), "left").select(*carried.restored(), "_digest", "_license")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    c = f"translate(coalesce({text}, ''), chr(13) || '{_UPPER}', chr(10) || '{_LOWER}')"
    c = f"regexp_replace({c}, {_quoted(_COPYRIGHT)}, chr(10) || '{chr(92)}6', 'g')"
    c = f"translate({c}, {_quoted(_SIGNS)}, {_quoted(' ' * len(_SIGNS))})"
    c = f"' ' || regexp_replace({c}, {_quoted(_PUNCTUATION)}, ' ', 'g') || ' '"
    for pattern, by in _SPELLINGS:
        c = f"regexp_replace({c}, {_quoted(pattern)}, {_quoted(by.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


#: DuckDB: the same over ``documents``, by the digests of all known forms.
ORACLE = f"""
WITH known(license_id, digest) AS (VALUES {", ".join(f"('{i}', '{x}')" for i, x in _forms())}),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, docs.digest AS digest, license_id FROM docs LEFT JOIN known ON docs.digest = known.digest
"""
