"""License scans: entire licence texts and notices, brought to a canonical form, looked up by digest.

A known text is found wherever it stands, over as many lines as it may be wrapped: each place of a
document's canonical text where the first words of a known text stand gives one digest for every size that known texts
with this beginning have, and digests are joined with the known ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, ship
from corpusloom.session import is_small

ship(__name__)

#: Texts of the licences that are short.
MIT_TEXT = (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        'including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        'sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
        'furnished to do so, subject to the following conditions: The above copyright notice and this '
        'permission notice shall be included in all copies or substantial portions of the Software. THE '
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        'IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER '
        'LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN '
        'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
BSD_CONDITIONS = (
        'Redistribution and use in source and binary forms, with or without modification, are permitted '
        'provided that the following conditions are met: 1. Redistributions of source code must retain the '
        'above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following '
        'disclaimer in the documentation and/or other materials provided with the distribution.'
)
BSD_NAMES = (
        '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse '
        'or promote products derived from this software without specific prior written permission.'
)
BSD_DISCLAIMER = (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
        'IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        'FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR '
        'CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL '
        'DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, '
        'DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER '
        'IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF '
        'THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
#: Notices by licence, and whole licences.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MIT", MIT_TEXT),
    ("BSD-2-Clause", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
)
#: Licences that are long, by what stands between their headings of terms and the end of them:
#: first words, characters and SHA-256 of the canonical text.
LONG_TEXTS = (
    ("Apache-2.0", "terms and conditions", 8733, "662187af981438b8de439e4f60f7eee59f3b3a2e4e1158a4afc7fea44c427b96"),
    ("GPL-2.0", "terms and conditions", 11754, "3f958b21a3b845584f2d713fa188af70b7ac47ae215bd66f2f465a9daac11adb"),
    ("GPL-3.0", "terms and conditions", 27577, "fd4c66a907c7b6f7fecae7eee705e740e20bc16364efaa6a30bb171995b97dbc"),
    ("LGPL-2.1", "terms and conditions", 17613, "54cd0bf6ccd7c9931df9069059dd8053edc06d641c520cd8e8ddccb6423d41b3"),
    ("MPL-2.0", "1 definitions 1", 13626, "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3"),
)
#: Spellings that mean the same; pairs of words first, in this order, then single words.
SPELLINGS = (
    ("gnu gpl", "gpl"),
    ("creative commons", "cc"),
    ("non commercial", "nc"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("ver", "version"),
    ("v", "version"),
    ("gpl", "gnu general public license"),
    ("noncommercial", "nc"),
    ("attribution", "by"),
)
#: A line of its own that names an owner: the word with a sign or a year, a sign with a year, or the rights.
COPYRIGHT_LINE = (
    r"(?im)^[^a-z0-9\n]*(?:copyright\b[^\n]*(?:\(c\)|©|\d{4})|(?:\(c\)|©)[^\n]*\d{4}|all rights reserved)[^\n]*$"
)
#: Words that a known text is recognised by, before a digest is made; and how many beginnings and sizes a scan takes along.
FIRST, SENT = 3, 100_000
_LINE = re.compile(COPYRIGHT_LINE.encode())
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_PAIRS = [(re.compile(rb"\b" + old.encode() + rb"\b"), old.encode(), new.encode()) for old, new in SPELLINGS if " " in old]
_SINGLE = {old.encode(): new.encode() for old, new in SPELLINGS if " " not in old}


def canonical(text: bytes) -> bytes:
    """A-Z lower-cased, no copyright lines, words of a-z and 0-9 with one blank between, one spelling."""
    out = b" ".join(_LINE.sub(b"", text).translate(_TABLE).split())
    for pattern, old, new in _PAIRS:
        if old in out:
            out = pattern.sub(new, out)
    return b" ".join([_SINGLE.get(w, w) for w in out.split()])


def beginning(text: bytes) -> bytes:
    return b" ".join(text.split(b" ", FIRST)[:FIRST])


def known_digests(spark: SparkSession, known=KNOWN, long_texts=LONG_TEXTS) -> DataFrame:
    """``licence``, ``first``, ``size``, ``digest`` of each known text that has a word."""
    rows = [(name, canonical(text.encode())) for name, text in known]
    rows = [(n, beginning(c).decode(), len(c), hashlib.sha256(c).hexdigest()) for n, c in rows if c]
    return spark.createDataFrame(rows + list(long_texts), "licence string, first string, size int, digest string").distinct()


def found_digests(docs: DataFrame, wanted: dict[str, list[int]]) -> DataFrame:
    """``docs`` (``_id``, ``_k1``, ``_k2``, ``_text``) with ``_places`` instead of the text: (at, size, whole, digest) where a known text may stand."""
    sought = [(b" " + first.encode(), sorted(sizes)) for first, sizes in sorted(wanted.items())]
    place = pa.struct([("at", pa.int64()), ("size", pa.int64()), ("whole", pa.bool_()), ("digest", pa.string())])

    def places(text: bytes) -> list[dict]:
        out, held = [], b" " + canonical(text) + b" "
        for first, sizes in sought:
            at = held.find(first)
            while at >= 0:
                for n in sizes:
                    if held[at + n + 1 : at + n + 2] == b" ":
                        digest = hashlib.sha256(held[at + 1 : at + n + 1]).hexdigest()
                        out.append({"at": at, "size": n, "whole": n + 2 == len(held), "digest": digest})
                at = held.find(first, at + 1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 500):
                found = [places(t or b"") for t in batch.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(place))], ["_id", "_k1", "_k2", "_places"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"_id {kind}, _k1 bigint, _k2 bigint, _places array<struct<at:bigint,size:bigint,whole:boolean,digest:string>>"
    )


def license_scan(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``licences`` (sorted names, comma-joined), ``n_notices``, ``whole_text``.

    ``known`` has ``licence``, ``first``, ``size`` and ``digest`` (the least name wins where texts
    agree). Every place of the whole text is looked up, over line ends and within lines; ``n_notices``
    counts the texts found, without those that stand within another; ``whole_text`` says that one is the
    document. Beginnings and sizes go to the tasks, ``SENT`` at most (more are an error); known digests are broadcast
    only if they are few, else joined. Null and empty texts and texts without a letter or digit match
    nothing. A repeated row gives its row again, an empty table none; other columns take no part.
    """
    names = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    asked = known.select("first", "size").distinct()
    if not is_small(asked, SENT):
        raise ValueError(f"more than {SENT} beginnings and sizes of known texts: scan for them in parts")
    wanted: dict[str, list[int]] = {}
    for r in asked.collect():
        wanted.setdefault(r["first"], []).append(r["size"])
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_k1"),
        F.xxhash64(text_col, F.lit("k2"), id_col).alias("_k2"), F.col(text_col).alias("_text"),
    )
    each = found_digests(rows, wanted).select("_id", "_k1", "_k2", F.posexplode_outer("_places").alias("_at", "p"))
    digests = each.withColumn("digest", F.col("p.digest"))
    met = digests.join(F.broadcast(names) if is_small(names) else names, "digest", "left")
    hit = F.when(F.col("licence").isNotNull(), F.struct("p.at", (F.col("p.at") + F.col("p.size")).alias("end"), "p.whole", "licence"))
    per_text = met.groupBy("_id", "_k1", "_k2").agg(
        F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_n"), F.collect_set(hit).alias("_hits")
    )
    # by start, the longer first: a text within another ends before the furthest end so far
    ordered = F.array_sort("_hits", lambda a, b: F.when(a["at"] != b["at"], (a["at"] - b["at"])).otherwise(b["end"] - a["end"]).cast("int"))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    counted = F.aggregate(ordered, zero, lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + (x["end"] > s["end"]).cast("bigint")).alias("n")
    ))
    return per_text.select(
        F.col("_id").alias(id_col),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["licence"]))), ",").alias("licences"),
        counted["n"].alias("n_notices"),
        F.exists("_hits", lambda x: x["whole"]).alias("whole_text"),
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"),
    ).drop("_copy")
