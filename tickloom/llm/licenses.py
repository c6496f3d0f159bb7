"""Licence scan by canonical digests: texts are brought to one form and looked up whole."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import content_key

# Spellings that licence matching guidelines treat as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled", "centre": "center", "colour": "color",
    "favour": "favor", "fulfilment": "fulfillment", "initialise": "initialize", "labelled": "labeled", "licence": "license",
    "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "organisation": "organization", "organisations": "organizations",
    "practise": "practice", "programme": "program", "recognised": "recognized", "sublicence": "sublicense", "utilisation": "utilization", "https": "http",
}
# Licence names as notices write them, by SPDX identifier.
NAMES = {
    "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
NOTICES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is released under {}.", "Licensed under the terms of {}.")
# Whole licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"\W*(copyright\b(?!\s+(notice|holder|owner|law))|\(c\)|©|all rights reserved)", re.IGNORECASE)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole texts and of every notice that the names give."""
    out = list(TEXTS.items())
    for licence, names in NAMES.items():
        out.append((licence, f"SPDX-License-Identifier: {licence}"))
        for name in names:
            for notice in NOTICES:
                out += [(licence, notice.format(name)), (licence, notice.format(f"the {name}"))]
    return out


def canonical_line(line: str) -> str:
    """Lower-case words of a line in common spelling, joined by blanks; a copyright line is empty."""
    if _COPYRIGHT.match(line):
        return ""
    return " ".join(SPELLINGS.get(w, w) for w in _WORD.findall(line.lower()))


def digest(canonical: str) -> bytes | None:
    return hashlib.sha256(canonical.encode()).digest() if canonical else None


def digest_of(text: str) -> bytes | None:
    """Digest of a whole text; None if no words are left."""
    return digest(" ".join(filter(None, map(canonical_line, text.split("\n")))))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence), one row per known text."""
    found = {digest_of(text): licence for licence, text in (known_texts() if texts is None else texts)}
    return spark.createDataFrame([(bytearray(d), licence) for d, licence in found.items() if d], "digest binary, licence string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _th, line, digest): line -1 is the whole text."""
    for batch in batches:
        row, line, digests = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            lines = [canonical_line(x) for x in (text or "").split("\n")]
            row.append(i)
            line.append(-1)
            digests.append(digest(" ".join(filter(None, lines))))
            for k, canonical in enumerate(lines):
                if canonical:
                    row.append(i)
                    line.append(k)
                    digests.append(digest(canonical))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("_th").take(at), pa.array(line, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "_th", "line", "digest"])


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, _th, licence, notices), a row for each row of ``docs``.

    A text is folded to lower case, rid of punctuation and copyright lines, and brought to common spellings; ``licence`` is the
    one whose known text it then equals as a whole. Each line is also taken as a text of its own: ``notices`` are
    (line, licence) of the lines that are known texts, ordered. Null, empty and wordless texts match nothing; repeated rows
    get equal results, other columns are ignored. ``known`` is (digest, licence); Spark broadcasts it while it is small.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", content_key(docs), "text")
    found = keyed.mapInArrow(_digests, f"doc_id {ids}, _th long, line int, digest binary").join(known, "digest")
    per_row = found.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_t")).agg(
        F.max(F.when(F.col("line") < 0, F.col("licence"))).alias("licence"),
        F.array_sort(F.collect_set(F.when(F.col("line") >= 0, F.struct("line", "licence")))).alias("notices"),
    )
    rows = keyed.select("doc_id", "_th")
    none = F.array().cast("array<struct<line:int,licence:string>>")
    joined = rows.join(per_row, rows["doc_id"].eqNullSafe(per_row["_id"]) & (rows["_th"] == per_row["_t"]), "left")
    return joined.select("doc_id", "_th", "licence", F.coalesce("notices", none).alias("notices"))
