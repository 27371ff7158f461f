"""License scans: canonical digests of entire texts, looked up by a hash join.

A unit (a whole document, or one of its lines) is brought to a canonical form: lower case, without
copyright lines, equivalent spellings as one, punctuation and white space as single spaces. Its
digest is joined to the digests of known licence texts and notices, a table of fixed size: KNOWN, and
the digests of full texts in license_digests.csv. Units are thinned first by words that known texts hold.

Defined results: a null or empty text has no units; rows that repeat an id are pooled into one
row, null ids among them; repeated lines count each time; texts of any length are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import csv
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import table

#: Public licence texts and notices (id, text); each holds "licen" in some form.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Spellings that mean the same, as word patterns and what they become, in order.
SPELLINGS = (
    (r"\blicen[cs]e(s|d)?\b", r"license\1"),
    (r"\bsub[- ]licen[cs]e(s|d)?\b", r"sublicense\1"),
    (r"\bsublicen[cs]e(s|d)?\b", r"sublicense\1"),
    (r"\borganisation(s)?\b", r"organization\1"),
    (r"\bmerchantibility\b", r"merchantability"),
    (r"\bnon[- ]infringement\b", r"noninfringement"),
    (r"\bhttps?:", r"https:"),
    (r"\b(version|ver\.?|v\.?) ?([0-9])", r"version \2"),
    (r"&", r" and "),
)
#: A line that names a copyright holder; such lines aren't part of a licence.
COPYRIGHT = r"(?im)^[^a-z\n]*(copyright\b|\(c\)|©)[^\n]*$"


def _java(replacement: str) -> str:
    return replacement.replace("\\", "$")


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, COPYRIGHT, " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, _java(to))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


#: Words that a spelling makes or takes away, so that a text may hold them otherwise than its canonical form.
_CHANGED = re.compile(r".*licen[cs]e.*|organi[sz]ations?|merchant[ai]bility|non|infringement|noninfringement|https?|ver|v|version|and")


def full_texts() -> list[tuple[str, str, str]]:
    """(license, digest, word that the text holds) of the full texts."""
    with open(os.path.join(os.path.dirname(__file__), "license_digests.csv"), newline="") as f:
        return [tuple(row) for row in csv.reader(f)]


def anchor(text: str) -> str:
    """A string that each spelling of the text holds in lower case; empty where none is sure."""
    words = re.findall(r"(?<![a-z0-9])[a-z]+(?![a-z0-9])", re.sub(COPYRIGHT, " ", text).lower())
    if any(re.search("licen[cs]e", w) for w in words):
        return "licen"
    return max((w for w in words if w.isascii() and not _CHANGED.fullmatch(w)), key=len, default="")


def _anchors(texts) -> str:
    found = {anchor(t) for _, t in texts} | ({a for _, _, a in full_texts()} if texts is KNOWN else set())
    return "" if "" in found else "|".join(sorted(found))


def known(spark, texts=KNOWN) -> DataFrame:
    rows = spark.createDataFrame(list(texts), "license string, text string")
    rows = rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if texts is KNOWN:
        rows = rows.union(spark.createDataFrame([x[:2] for x in full_texts()], "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts=KNOWN) -> DataFrame:
    """One row per id: the licence that the whole text is, how many lines are one, and which."""
    body = F.col(f"`{text_col}`").cast("string")
    words = _anchors(texts)
    likely = docs.select(F.col(f"`{id_col}`").alias("id"), F.when(F.lower(body).rlike(words), body).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike(words))
    units = likely.select("id", F.explode_outer(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))).alias("u"))
    digests = units.select("id", "u.whole", F.sha2(canonical(F.col("u.unit")), 256).alias("digest"))
    found = digests.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left")  # the known texts are a fixed table
    hit = F.col("license").isNotNull()
    return found.groupBy("id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.count(F.when(hit & ~F.col("whole"), 1)).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    ).withColumnRenamed("id", id_col)


def op1_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def form(x: str) -> str:
        out = f"lower(regexp_replace({x}, '{COPYRIGHT}', ' ', 'g'))"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"

    rows = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN)
    digests = ", ".join(f"('{a}', '{b}')" for a, b, _ in full_texts())
    return rf"""WITH known AS (SELECT digest, min(l) license FROM (SELECT l, sha256({form("t")}) digest FROM (VALUES {rows}) v(l, t) UNION ALL SELECT l, h FROM (VALUES {digests}) w(l, h)) GROUP BY digest),
u AS (SELECT doc_id, true whole, text unit FROM documents UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents),
f AS (SELECT doc_id, whole, license FROM (SELECT doc_id, whole, sha256({form("unit")}) digest FROM u WHERE regexp_matches(lower(unit), '{_anchors(KNOWN)}')) JOIN known USING (digest))
SELECT d.doc_id, min(license) FILTER (whole) whole_license, count(*) FILTER (license IS NOT NULL AND NOT whole) n_license_lines, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id GROUP BY d.doc_id"""


OP1_SQL = _sql()
