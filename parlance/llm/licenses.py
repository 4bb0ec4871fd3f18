"""Licence scans: canonical digests of entire texts, hash-joined to those of known licences.

The unit is an entire text: the whole document, and each whole line of it (notices stand on
lines of their own).  Both are brought to a canonical form before hashing: lower case, copyright
lines removed, one spelling of each word, runs of anything but letters and digits as one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.frames import documents

# Spellings that licence texts use for the same word, other form first.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "organisations": "organizations",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Clauses that several licences share.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Known licence notices, headers of files, and whole short licences.
KNOWN = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [_BSD_GRANT + _BSD_AS_IS],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD_GRANT + _BSD_THIRD + _BSD_AS_IS],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ],
    "MIT-0": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _AS_IS,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
}

COPYRIGHT_LINE = r"^[ \t]*(copyright\b|\(c\)|©|all rights reserved)"
_VARIANT = r"\b(" + "|".join(SPELLINGS) + r")\b"
#: Distinct lengths of known forms up to which lines of any other length are not hashed at all.
LENGTHS = 1000


def _spelled(form: Column) -> Column:
    for other, chosen in SPELLINGS.items():
        form = F.regexp_replace(form, rf"\b{other}\b", chosen)
    return form


def with_forms(texts: DataFrame) -> DataFrame:
    """Adds ``forms``, the canonical form of each line of ``text``, and ``form``, that of the whole.

    Lines are worked on once: the whole's form is that of its lines, joined by a space.  Texts
    without any variant spelling are told by one search and not searched for each of them.
    """
    low = texts.withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    lines = low.withColumn("varies", F.col("text").rlike(_VARIANT)).withColumn(
        "forms", F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(COPYRIGHT_LINE), "").otherwise(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))))
    )
    spelled = lines.withColumn("forms", F.when(F.col("varies"), F.transform("forms", _spelled)).otherwise(F.col("forms")))
    return spelled.withColumn("form", F.array_join(F.filter("forms", lambda x: x != ""), " ")).drop("varies", "text")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, texts in KNOWN.items() for t in texts], "license_id string, text string")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license_id (of the whole text, null if none), n_notices, notices (ids of matching lines, sorted, joined by commas).

    A row for each row's doc_id: repeated rows meet in one.  Null, empty and letterless texts
    match nothing.  Known texts that come to the same canonical form keep the least license_id.
    """
    digests = with_forms(known.select("license_id", "text")).where("form <> ''").groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("length")).agg(F.min("license_id").alias("license_id"))
    plain = documents(docs)
    units = with_forms(plain).select("doc_id", F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("form"))), F.transform("forms", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("form")))).alias("units"))
    # explode() would have Spark work out the arrays once more, to leave out empty ones.
    each = units.select("doc_id", F.explode_outer("units").alias("u")).select("doc_id", "u.whole", "u.form")
    lengths = [r["length"] for r in digests.select("length").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) <= LENGTHS:
        each = each.where(F.length("form").isin(lengths))
    found = each.where("form <> ''").select("doc_id", "whole", F.sha2("form", 256).alias("digest")).join(digests.drop("length"), "digest").groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    )
    return plain.select("doc_id").distinct().join(found, "doc_id", "left").select(
        "doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"),
        F.when(F.coalesce("notices", F.lit("")) == "", 0).otherwise(F.size(F.split("notices", ","))).cast("long").alias("n_notices"),
    )


def license_scan_sql() -> str:
    def form(text: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({text}), '(?m)^[ \\t]*(copyright\\b|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for other, chosen in SPELLINGS.items():
            out = f"regexp_replace({out}, '\\b{other}\\b', '{chosen}', 'g')"
        return out

    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, texts in KNOWN.items() for t in texts)
    return f"""
    WITH known AS (SELECT {form("t")} AS form, min(k) AS license_id FROM (VALUES {values}) v(k, t) GROUP BY 1),
    units AS (SELECT doc_id, true AS whole, text AS unit FROM documents
              UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents),
    forms AS (SELECT doc_id, whole, {form("unit")} AS form FROM units),
    found AS (SELECT doc_id, min(license_id) FILTER (WHERE whole) AS license_id,
                     list_sort(list(DISTINCT license_id) FILTER (WHERE NOT whole)) AS ids
              FROM forms JOIN known USING (form) WHERE form <> '' GROUP BY doc_id)
    SELECT d.doc_id, f.license_id, coalesce(array_to_string(f.ids, ','), '') AS notices,
           CAST(coalesce(len(f.ids), 0) AS BIGINT) AS n_notices
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN found f ON d.doc_id = f.doc_id"""
