"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form line by line: lower case, every run of characters other than
letters and digits one blank, words of equivalent spelling made equal; copyright lines, title lines
("MIT License") and lines without a word are left out.  A unit of a document is a run of its
remaining lines, one line and the whole text included, and matches entire: its digest is joined to
the digests of known licences.  A known text may be wrapped otherwise, since only words count, but a
unit begins and ends at the ends of lines.

Runs are found by their heads: the first ``HEAD`` words from each line on are looked up among the heads
of the known texts, and only where one is met a run of that text's length is formed and hashed.
Every line so costs one small row, whatever the number and length of the known texts.  Known licences
come from a table; they are broadcast when their counted rows are small and joined by a shuffle
otherwise.  Distinct units of a document are matched once.

Null or empty texts, and texts that are nothing but copyright or title lines, have no units.  Null
ids stay null.  Repeated rows count once.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.shared import stored
from fieldloom.session import sized_broadcast

# Spellings taken as equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "analog": "analogue", "authorisation": "authorization",
    "authorised": "authorized", "behaviour": "behavior", "favour": "favor", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "organisation": "organization",
    "organisations": "organizations", "recognised": "recognized", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "v1": "1", "v2": "2", "v3": "3", "v4": "4",
}
# Dropped words.
DROPPED = ["version", "the"]
# Public licence texts and notices.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ],
    "GPL-3.0-or-later": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
}
# Canonical lines that only name a licence.
TITLES = [
    "mit license", "mit license mit", "isc license", "isc license isc", "bsd license", "bsd 2 clause license", "bsd 3 clause license",
    "simplified bsd license", "new bsd license", "zlib license", "apache license", "apache license 2 0", "mozilla public license 2 0",
    "mozilla public license", "gnu general public license", "gnu lesser general public license", "license", "license text",
]
HEAD = 5
SPLIT = r"[^\p{L}\p{N}]+"
COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright|©|\(c\)).*"


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without those that are left out."""

    def line(x: Column) -> Column:
        words = F.filter(F.split(x, SPLIT), lambda w: ~w.isin("", *DROPPED))
        return F.when(x.rlike(COPYRIGHT), "").otherwise(F.array_join(F.transform(words, _same), " "))

    every = F.transform(F.split(F.lower(text), "\n", -1), line)
    return F.filter(every, lambda x: ~x.isin("", *TITLES))


def _same(word: Column) -> Column:
    out = F.lit(None)
    for a, b in SPELLINGS.items():
        out = F.when(word == a, b).otherwise(out)
    return F.when(word.isin(*SPELLINGS), out).otherwise(word)


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in licences."""
    rows = [(k, t) for k, texts in KNOWN.items() for t in texts]
    entries = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in rows))
    return spark.range(1).select(F.inline(entries))


def read_licences(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, text) of a folder with one text file per licence, named by its id."""
    files = spark.read.text(folder, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    return files.select(name.alias("license_id"), F.col("value").alias("text"))


def _head(lines: str) -> str:
    """SQL for the first ``HEAD`` words from line ``i`` (from 0) on; every line has a word."""
    return f"substring_index(array_join(slice({lines}, i + 1, {HEAD}), ' '), ' ', {HEAD})"


def _words(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')) + 1)"


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, n_units, whole_text): licences of every document that has one.

    ``n_units`` counts the distinct canonical units that are this licence; ``whole_text`` tells whether
    one is all there is.
    """
    texts = known.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("unit")).where("unit <> ''").distinct()
    texts = texts.select("license_id", F.sha2("unit", 256).alias("digest"), F.expr(_words("unit")).alias("n"),
                         F.xxhash64(F.substring_index("unit", " ", HEAD)).alias("head"))
    heads = texts.select("head", "n").distinct()
    size = texts.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    starts = F.expr(f"transform(lines, (x, i) -> struct(i AS i, xxhash64({_head('lines')}) AS head))")
    # Only the numbers of lines with a known head stay beside a document's lines.
    met = rows.select("doc_id", F.xxhash64("lines").alias("of"), F.inline(starts)).join(sized_broadcast(heads, size, 32), "head")
    met = stored(met.select("doc_id", "of", "i", "n").distinct())
    few = sized_broadcast(met.withColumnsRenamed({"doc_id": "d", "of": "o"}), met.count(), 40)
    runs = rows.withColumn("of", F.xxhash64("lines")).join(few, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")))
    run = "slice(lines, i + 1, n)"
    runs = runs.withColumn("unit", F.expr(f"substring_index(array_join({run}, ' '), ' ', n)"))
    # Words up to the end of each line of the run: one of them has to be all n.
    ends = F.expr(f"aggregate({run}, struct(0 AS words, 0 AS lines), (a, x) -> if(a.words >= n, a, "
                  f"struct(int(a.words + {_words('x')}) AS words, int(a.lines + 1) AS lines)))")
    runs = runs.withColumn("end", ends).where("end.words = n")
    units = runs.select("doc_id", F.sha2("unit", 256).alias("digest"), F.expr("i = 0 AND end.lines = size(lines)").alias("whole_text"))
    found = units.join(sized_broadcast(texts.select("license_id", "digest").distinct(), size, 256), "digest")
    found = found.groupBy("doc_id", "license_id", "digest").agg(F.max("whole_text").alias("whole_text"))
    return found.groupBy("doc_id", "license_id").agg(F.count("*").alias("n_units"), F.max("whole_text").alias("whole_text"))


def scan_sql() -> str:
    """DuckDB statement for ``scan`` of ``documents`` against the built-in licences."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(t)})" for k, texts in KNOWN.items() for t in texts)
    cases = " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in SPELLINGS.items())
    dropped = ", ".join(map(quote, DROPPED))
    titles = ", ".join(map(quote, TITLES))

    def lines(column: str) -> str:
        kept = f"list_filter(string_split(lower({column}), chr(10)), lambda l: NOT regexp_matches(l, {quote(COPYRIGHT)}))"
        words = f"list_filter(regexp_split_to_array(l, {quote(SPLIT)}), lambda w: w <> '' AND w NOT IN ({dropped}))"
        form = f"array_to_string(list_transform({words}, lambda w: CASE w {cases} ELSE w END), ' ')"
        return f"list_filter(list_transform({kept}, lambda l: {form}), lambda l: l <> '' AND l NOT IN ({titles}))"

    return f"""
WITH known AS (SELECT DISTINCT license_id, array_to_string({lines('t')}, ' ') unit FROM (VALUES {known}) v(license_id, t)),
heads AS (SELECT *, array_to_string(string_split(unit, ' ')[:{HEAD}], ' ') head, len(string_split(unit, ' ')) n FROM known WHERE unit <> ''),
docs AS (SELECT doc_id, {lines("coalesce(text, '')")} l FROM documents),
starts AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM docs),
runs AS (
  SELECT doc_id, license_id, unit, len(l) n_lines, i,
         list_filter(range(1, least(n, len(l) - i + 1) + 1), lambda m: array_to_string(l[i : i + m - 1], ' ') = unit) m
  FROM starts JOIN heads ON array_to_string(string_split(array_to_string(l[i : i + {HEAD - 1}], ' '), ' ')[:{HEAD}], ' ') = head)
SELECT doc_id, license_id, count(DISTINCT unit) AS n_units, bool_or(i = 1 AND m[1] = n_lines) AS whole_text
FROM runs WHERE len(m) > 0 GROUP BY doc_id, license_id"""
