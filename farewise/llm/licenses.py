"""Licence scan: canonical digests of whole texts hash-joined to the digests of known licence texts.

The canonical form lower-cases A-Z, drops copyright lines, turns ASCII punctuation and white space into single
spaces and writes equivalent spellings one way; its SHA-256 is the digest. A document's whole text is looked up, and
so is each of its lines, since short notices stand on a line of their own. A line is brought into canonical form only if its first
word can be the first of a known text (``first_words``, computed from all known texts): no other line can equal one.

The known texts are those below and ``license_texts/``: whole texts (``index.tsv``: file, id, first words after the
title) and names (``names.tsv``), from which titles and short notices are made. A text that names its holder anywhere
but in a copyright line (BSD-3-Clause: "neither the name of ...") is known only with the names in the files.

Null, empty and punctuation-only texts have a null digest and match nothing. Repeated rows give one row each.
``known`` may hold several ids of one digest: the smallest is reported.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, written as the second of each pair.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3"),
]
# Characters written as their ASCII equivalents.
CHARACTERS = [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("\u00a0", " ")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = "(?m)^[ \\t*#/;-]*(copyright|\\(c\\)|©)[ \\t]*(\\(c\\)|©|[0-9]{4}|<|\\[|\\{)[^\\n]*$"
RIGHTS_LINE = "(?m)^[ \\t*#/;-]*all rights reserved[.]?[ \\t]*$"
PUNCTUATION = "[!-/:-@\\[-`{-~\\x00-\\x20]+"

# Texts of known licences and notices (the usual short notices, and licences of a page at most).
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL)
_0BSD = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
         "granted.\n\n" + _ISC_TAIL)
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""
TEXTS = Path(__file__).with_name("license_texts")
#: Short notices made of each name, and of each id.
NAME_NOTICES = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.",
                "This work is licensed under a {}.", "This project is licensed under the {}.", "License: {}",
                "Licensed under {}.", "Released under {}."]
ID_NOTICES = ["SPDX-License-Identifier: {}", "License: {}"]


def _rows(name: str) -> list[list[str]]:
    return [r.split("\t") for r in (TEXTS / name).read_text(encoding="utf-8").splitlines()[1:]]


def shipped_texts() -> list[tuple[str, str]]:
    """(id, text) of the data files: whole texts with and without their titles, and short notices."""
    names = _rows("names.tsv")
    found = []
    for file, license_id, body in _rows("index.tsv"):
        text = (TEXTS / file).read_text(encoding="utf-8")
        found.append((license_id, text))
        if body:
            rest = text[re.search(r"\s+".join(map(re.escape, body.split())), text).start():]
            found += [(license_id, rest), *((i, f"{n}\n\n{rest}") for i, n in names if i == license_id and n)]
    found += [(i, notice.format(n)) for i, n in names if n for notice in NAME_NOTICES]
    found += [(i, notice.format(i)) for i in dict.fromkeys(i for i, _ in names) for notice in ID_NOTICES]
    return list(dict.fromkeys(found))


KNOWN = [
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("ISC", _ISC),
    ("0BSD", _0BSD),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "The ISC License\n" + _ISC),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
    ("Zlib", "zlib License\n" + _ZLIB),
    *shipped_texts(),
]


def canonical(text: Column) -> Column:
    """Canonical form of a text column ('' for null)."""
    a = UPPER + "".join(x for x, _ in CHARACTERS)
    b = LOWER + "".join(y for _, y in CHARACTERS)
    x = F.translate(F.coalesce(text, F.lit("")), a, b)
    x = F.regexp_replace(F.regexp_replace(x, F.lit(COPYRIGHT_LINE), F.lit("")), F.lit(RIGHTS_LINE), F.lit(""))
    # words stand between double spaces, so that neighbouring words can both be rewritten
    x = F.concat(F.lit(" "), F.regexp_replace(x, F.lit(PUNCTUATION), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(x, F.lit(" +"), F.lit(" ")))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if nothing is left of the text."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, license_id`` of a table ``license_id, text``."""
    made = known.select(digest(F.col("text")).alias("digest"), "license_id").filter("digest is not null")
    return made.groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: First word of a line as written; everything that the canonical form writes as a space ends a word.
FIRST_WORD = f"[^{PUNCTUATION[1:-2]}{''.join(x for x, _ in CHARACTERS)}]+"


def first_word(line: Column) -> Column:
    """The first word of a line, lower-cased, in the spelling in which it stands; '' if there is none."""
    return F.translate(F.regexp_extract(line, FIRST_WORD, 0), UPPER, LOWER)


def first_words(known: DataFrame) -> DataFrame:
    """``word``: all first words, however spelt, of lines whose canonical form may be that of a known text.

    "all" is one of them: a rights line may be dropped at a line end other than the line feed, and what follows comes first.
    """
    spark = known.sparkSession
    first = known.select(F.split(canonical(F.col("text")), " ")[0].alias("word")).filter("word <> ''").distinct()
    spelt = spark.createDataFrame([(new.split()[0], old.split()[0]) for old, new in SPELLINGS], "word string, old string")
    return first.unionByName(first.join(spelt, "word").select(F.col("old").alias("word"))) \
        .unionByName(spark.createDataFrame([("all",)], "word string")).distinct()


def default_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, digest, license_id, notice_ids`` for every row.

    ``license_id``: the known licence whose text is the whole document. ``notice_ids``: sorted ids, comma-separated,
    of known texts that are one of its lines. Joins are plain equi-joins; Spark broadcasts the known side only if
    it is below its own size limit.
    """
    known = default_known(docs.sparkSession) if known is None else known
    look = known_digests(known)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = (rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
             .withColumn("word", first_word(F.col("line"))).join(first_words(known), "word", "left_semi")
             .select("doc_id", digest(F.col("line")).alias("digest")).filter("digest is not null")
             .join(look, "digest").groupBy("doc_id")
             .agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notice_ids")))
    whole = rows.select("doc_id", digest(F.col("text")).alias("digest")).join(look, "digest", "left")
    return whole.join(lines, "doc_id", "left").select("doc_id", "digest", "license_id", "notice_ids")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    a = UPPER + "".join(x for x, _ in CHARACTERS)
    b = LOWER + "".join(y for _, y in CHARACTERS)

    def canon(col: str) -> str:
        x = f"translate(coalesce({col}, ''), {_literal(a)}, {_literal(b)})"
        for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
            x = f"regexp_replace({x}, {_literal(pattern)}, '', 'g')"
        x = f"' ' || regexp_replace({x}, {_literal(PUNCTUATION)}, '  ', 'g') || ' '"
        for old, new in SPELLINGS:
            x = f"replace({x}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    def dig(col: str) -> str:
        return f"sha256(nullif({canon(col)}, ''))"

    values = ", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in KNOWN)
    return f"""
WITH look AS (SELECT {dig('t')} AS digest, min(i) AS license_id FROM (VALUES {values}) k(i, t) GROUP BY 1),
lines AS (SELECT doc_id, {dig('line')} AS digest
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids
            FROM lines JOIN look USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {dig('text')} AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license_id, n.notice_ids
FROM whole w LEFT JOIN look k USING (digest) LEFT JOIN notices n ON w.doc_id = n.doc_id"""
