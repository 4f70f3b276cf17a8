"""License scans: texts in a canonical form, hash-joined to the digests of known licences.

Case, punctuation, white space, copyright lines and equivalent spellings are normalised; a document whose entire text is
then a known licence gets its name by an equality join on the digest. Single lines that are known notices are found by
the same join, once lines are rows. The known licences are the public texts in known_licenses/, named by SPDX identifier,
and the short ones below; a text also counts without its title, and without what follows the end of its terms. The same
expressions are written for Spark and for SQL.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(^|\n)[ \t]*((portions )?copyright[ \t]*(\(c\)|©|:)?[ \t]*[\[<({]?([0-9]{4}|year|yyyy)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
# Spellings that count as the same, after punctuation is gone, with a space on either side.
SAME = [(" licence ", " license "), (" licences ", " licenses "), (" licenced ", " licensed "), (" sub license ", " sublicense "), (" non infringement ", " noninfringement "),
        (" organisation ", " organization "), (" favour ", " favor "), (" whilst ", " while "), (" acknowledgement ", " acknowledgment "), (" merchantibility ", " merchantability "),
        (" copyright owner ", " copyright holder "), (" http ", " https "), (" v2 0 ", " version 2 0 "), (" v3 ", " version 3 "), (" per cent ", " percent ")]
# Short public licence texts, and notices, by SPDX identifier.
SHORT_TEXTS = [
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


END_OF_TERMS = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", re.M)


def variants(text: str) -> list[str]:
    """A licence's text, without its title, and without what follows the end of its terms."""
    first, _, rest = text.strip("\n").partition("\n\n")
    out = [text]
    if rest and not first.rstrip().endswith(".") and len(first.splitlines()) <= 3:
        out.append(rest)
    ends = [m for t in out for m in [END_OF_TERMS.search(t)] if m]
    return out + [m.string[: m.end()] for m in ends] + [m.string[: m.start()] for m in ends]


def whole_texts() -> list[tuple[str, str]]:
    """(identifier, text) of the known licences, as they were published."""
    files = resources.files(__package__) / "known_licenses"
    long = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files.iterdir() if f.name.endswith(".txt"))
    return long + [(name, text) for name, text in SHORT_TEXTS if "\n" in text]


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of all variants of the known licences, and of the notices; some hundred."""
    return [(name, v) for name, text in whole_texts() for v in variants(text)] + [(name, text) for name, text in SHORT_TEXTS if "\n" not in text]


def _line(line: Column) -> Column:
    """A lower-case line without punctuation; of a copyright line what stands before the notice."""
    some = F.contains(line, F.lit("copyright")) | F.contains(line, F.lit("©")) | F.contains(line, F.lit("(c)")) | F.contains(line, F.lit("all rights reserved"))
    bare = F.when(some, F.regexp_replace(line, F.lit(COPYRIGHT), F.lit(""))).otherwise(line)
    return F.trim(F.regexp_replace(bare, F.lit(OTHER), F.lit(" ")))


def _spelled(t: Column) -> Column:
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for a, b in SAME:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def _lines(text: Column) -> Column:
    """The lines of a text without copyright lines, case and punctuation; those that are left."""
    return F.filter(F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n"), _line), lambda x: x != "")


def canonical(text: Column) -> Column:
    """The canonical form of a text, words with single spaces between; of a null text the empty string."""
    return _spelled(F.array_join(_lines(text), " "))


def canonical_sql(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {q(COPYRIGHT)}, chr(10), 'g')"
    t = f"concat(' ', trim(regexp_replace({t}, {q(OTHER)}, ' ', 'g')), ' ')"
    for a, b in SAME:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"trim({t})"


def known_licenses(spark: SparkSession, texts=None) -> DataFrame:
    """license_id and digest of the known texts, and the first letters of their canonical forms; some hundred."""
    rows = spark.createDataFrame([(a, b) for a, b in (texts or known_texts())], "license_id string, text string").withColumn("c", canonical(F.col("text")))
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.substring("c", 1, HEAD)).alias("head"))


#: First letters of a line that tell whether it can be a notice; respelling changes them in the words listed after.
HEAD = 3
RESPELLED = {b.strip()[:HEAD].strip(): a.strip()[:HEAD] for a, b in SAME if a.strip()[:HEAD] != b.strip()[:HEAD]}


def scan(docs: DataFrame, texts=None) -> DataFrame:
    """doc_id, digest, license_id and notices of every row of docs (doc_id, text, any others).

    texts are (name, text) of known licences, some hundred. digest is that of the canonical text; license_id names the
    known licence that the entire text is, else null; notices are the names, sorted, each once and joined by commas, of
    known texts that single lines are. A null or empty text has the digest of the empty string, no licence and no
    notices. Rows stay apart, repeated ones too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = scratch.keep(known_licenses(spark, texts).where(F.col("head") != ""), "known")
    heads = {r["head"] for r in known.select("head").distinct().collect()}
    heads |= {v for k, v in RESPELLED.items() if any(h.startswith(k) for h in heads)}
    names = known.select("digest", "license_id")
    # a line is hashed only if it begins as some known text does
    candidates = F.transform(F.filter("_lines", lambda x: F.substring(x, 1, HEAD).isin(sorted(heads))), lambda x: F.sha2(_spelled(x), 256))
    base = docs.select("doc_id", _lines(F.col("text")).alias("_lines"))
    base = scratch.keep(base.select("doc_id", F.sha2(_spelled(F.array_join("_lines", " ")), 256).alias("digest"), candidates.alias("lines")), "digests")
    # rows with one doc_id and one digest have the same notices
    lines = base.select("doc_id", "digest", F.explode("lines").alias("line")).distinct()
    found = lines.join(F.broadcast(names.select(F.col("digest").alias("line"), "license_id")), "line")
    found = found.groupBy("doc_id", "digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "notices")
    out = base.join(F.broadcast(names), "digest", "left").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def scan_sql(table: str = "documents") -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in known_texts())
    return f"""
WITH known AS (SELECT sha256({canonical_sql('t')}) AS digest, min(n) AS license_id FROM (VALUES {values}) AS v(n, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM {table}),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN known ON known.digest = sha256({canonical_sql('line')}) GROUP BY r),
w AS (SELECT r, doc_id, sha256({canonical_sql('text')}) AS digest FROM d)
SELECT w.doc_id, w.digest, known.license_id, coalesce(m.notices, '') AS notices
FROM w LEFT JOIN known ON known.digest = w.digest LEFT JOIN m ON m.r = w.r"""
