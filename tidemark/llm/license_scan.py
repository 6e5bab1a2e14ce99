"""Licence scan by canonical digest: a text that is a known licence, or a line that is a known notice, whole, in any of
its spellings.

Built-in functions only. A text is put in canonical form (case, spelling, copyright lines, punctuation and space), and
its SHA-256 is joined by hash to the digests of known licences in the same form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, checkpoint

# Texts of licences as their owners publish them.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_LINE = "Licensed under the Apache License, Version 2.0."
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (("MIT", MIT), ("ISC", ISC), ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3), ("Zlib", ZLIB), ("0BSD", ZERO_BSD), ("Apache-2.0-notice", APACHE_NOTICE), ("Apache-2.0-line", APACHE_LINE), ("GPL-3.0-notice", GPL3_NOTICE))
#: Notices of one line; each holds a word that NOTICE finds.
NOTICES = (
    ("Apache-2.0-line", APACHE_LINE),
    ("MIT-line", "Released under the MIT License."),
    ("MIT-line", "Licensed under the MIT License."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause-line", "Licensed under the BSD 3-Clause License."),
)
NOTICE = "(?i)licen[cs]e"

#: Equivalent spellings, applied in order to lower-case text: (pattern, replacement).
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("https:", "http:"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("unauthorised", "unauthorized"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Words behind "copyright" in running text that was wrapped before it; such a line is no copyright line.
RUNNING = "notices?|holders?|owners?|licenses?|laws?|statements?|interests?|disclaimers?|permissions?|protection|and|or|in|to|of|for|is|are"
#: A copyright line, up to its end: the word and something else than running text, the sign, or (c) and a year or name.
COPYRIGHT = rf"(^|\n)[ \t]*(copyright\b(?![ \t]*(\n|$))(?![ \t]+({RUNNING})\b)|©|\(c\)(?=[ \t]*(copyright|©|[<\[{{])|[^\n]*\b(19|20)[0-9][0-9]\b))[^\n]*"
OTHER = r"[^a-z0-9\x80-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), one spelling, no copyright lines, runs of anything but letters and digits one space, trimmed."""
    c = ascii_lower(text)
    c = F.regexp_replace(c, "\r\n?", "\n")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, COPYRIGHT, "$1")
    return F.trim(F.regexp_replace(c, OTHER, " "))


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _known(docs: DataFrame, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """(_digest, license): of texts with one canonical form the first by name; none with an empty one."""
    made = docs.sparkSession.createDataFrame(list(texts), "license string, _text string").select(_digest(F.col("_text")).alias("_digest"), "license")
    return made.where(F.col("_digest") != F.sha2(F.lit("").cast("binary"), 256)).groupBy("_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, key: str, text: str, known: tuple[tuple[str, str], ...] = KNOWN, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """One row for each row of docs: key, canonical_sha256, license (null where the text is no known licence, whole) and
    notices (names of the notices that a line of the text is, whole: sorted, comma-joined, null without any).

    known and notices are lists in the program, so they are broadcast; of licences with one canonical form the first by
    name counts. Null texts have neither digest nor licence. Texts that are empty in canonical form (only punctuation,
    say) have the digest of nothing and no licence. Repeated rows stay, other columns are dropped; an empty table gives
    an empty table. Texts are read once; what is joined are digests.
    """
    body = F.col(text)
    lines = F.transform(F.filter(F.split(body, "\r\n?|\n"), lambda l: l.rlike(NOTICE)), _digest)  # noqa: E741
    row = docs.select(F.col(key).alias("_key"), _digest(body).alias("canonical_sha256"), F.when(body.rlike(NOTICE), lines).alias("_lines"), F.monotonically_increasing_id().alias("_row"))
    rows = checkpoint(row)
    whole = _known(docs, known)
    named = rows.join(F.broadcast(whole), rows["canonical_sha256"] == whole["_digest"], "left").select("_row", "_key", "canonical_sha256", "license")
    line = rows.where("_lines is not null").select("_row", F.explode("_lines").alias("_digest"))
    found = line.join(F.broadcast(_known(docs, notices)), "_digest").groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return named.join(found, "_row", "left").select(F.col("_key").alias(key), "canonical_sha256", "license", "notices")


def sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(c: str) -> str:
        c = f"regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\r\\n?', chr(10), 'g')"
        for a, b in SPELLINGS:
            c = f"replace({c}, {q(a)}, {q(b)})"
        c = f"regexp_replace({c}, '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
        return f"sha256(trim(regexp_replace({c}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')))"

    rows = lambda texts: ", ".join(f"({q(n)}, {q(t)})" for n, t in texts)
    known = lambda texts: f"(SELECT min(license) AS license, {form('t')} AS digest FROM (VALUES {rows(texts)}) v(license, t) GROUP BY 2)"
    return f"""WITH known AS {known(KNOWN)}, notices AS {known(NOTICES)},
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {form('text')} AS canonical_sha256 FROM documents),
lines AS (SELECT r, unnest(regexp_split_to_array(text, '\\r\\n?|\\n')) AS line FROM docs WHERE regexp_matches(text, '{NOTICE}')),
found AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, {form('line')} AS digest FROM lines WHERE regexp_matches(line, '{NOTICE}')) l JOIN notices USING (digest) GROUP BY r)
SELECT d.doc_id, d.canonical_sha256, k.license, f.notices FROM docs d LEFT JOIN known k ON k.digest = d.canonical_sha256 AND k.digest <> sha256('') LEFT JOIN found f ON f.r = d.r"""
