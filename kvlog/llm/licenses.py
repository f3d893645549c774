"""License scan by canonical digest lookup.

A text is reduced to its canonical form (case, punctuation, copyright lines and equivalent spellings removed or
unified), hashed whole, and joined with the digests of known licence texts.  Whole texts are compared, so a licence
line inside other prose is no match of ``scan``.  ``scan_lines`` gives every line the same lookup, for notices.

Defined results: null, empty or all-punctuation text has canonical form '' and never matches; equal texts match
alike, and repeated rows or ids give one row each; a null doc_id stays null; very long texts are hashed whole; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings of licence prose (variant, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("colour", "color"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub licence", "sublicense"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Public licence texts and one-line notices, without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_BSD3 = _BSD2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
#: Texts beyond those of the oracle, which holds KNOWN only; whole texts of the folder come with and without their
#: appendix on how to apply them.
MORE = (
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("ISC", "The ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD2.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ")),
    *[("BSD-3-Clause", head + x) for x in (_BSD3, _BSD3.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")) for head in ("", "BSD 3-Clause License\n")],
    ("Unlicense", _UNLICENSE),
)
_FOLDER = Path(__file__).with_name("license_texts")
FILES = (
    ("Apache-2.0", "Apache-2.0"),
    ("CC0-1.0", "CC0-1.0"),
    ("GPL-2.0-only", "GPL-2"),
    ("GPL-3.0-only", "GPL-3"),
    ("LGPL-2.1-only", "LGPL-2.1"),
    ("LGPL-3.0-only", "LGPL-3"),
    ("MPL-2.0", "MPL-2.0"),
)
_END = "END OF TERMS AND CONDITIONS"

# A copyright line opens so and goes on with a sign, a year, a placeholder or a capitalised holder.
_NO_HOLDER = r"(?!(?i:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|disclaimers?|interests?|and|or|in|to|of|is|on|the\s+above)\b)"
COPYRIGHT_LINE = rf"(?m)^[\s/*#;-]*(?:(?i:copyright)[ \t]*:?[ \t]*(?:(?i:\(c\)|©|&copy;)|(?i:by)[ \t]+\p{{Lu}}|[<\[{{]|\d{{4}}\b|(?<=[ \t]){_NO_HOLDER}\p{{Lu}})[^\n]*|(?:\([cC]\)|©)[ \t]*(?i:copyright\b|\d{{4}}\b|[<\[{{])[^\n]*|(?i:all rights reserved)[ \t\r.]*)$"
#: That of the oracle: any line that opens with these words.
SQL_COPYRIGHT_LINE = r"(?mi)^[\s/*#;-]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def known_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN, MORE and the whole texts of the folder."""
    whole = [(k, (_FOLDER / f"{f}.txt").read_text("utf-8")) for k, f in FILES]
    cut = [(k, t[: t.index(_END) + n]) for k, t in whole if _END in t for n in (0, len(_END))]
    return KNOWN + MORE + tuple(whole + cut)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, letters and digits only, single blanks, canonical spellings."""
    c = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    c = F.replace(c, F.lit(" "), F.lit("  "))  # each word has blanks of its own, so neighbours are replaced alike
    for variant, form in SPELLINGS:
        c = F.replace(c, F.lit(f" {variant} ".replace(" ", "  ")[1:-1]), F.lit(f" {form} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row per distinct digest; its size is that of the parameter, never of the corpus."""
    df = spark.createDataFrame([(k, t) for k, t in known or known_texts()], "license string, body string")
    return df.groupBy(digest(F.col("body")).alias("digest")).agg(F.min("license").alias("license"))


def _lookup(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    known = known_digests(rows.sparkSession) if known is None else known
    return rows.join(F.broadcast(known) if known.count() <= 10_000 else known, "digest", "left")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical whole text, license (null: unknown) for every row."""
    return _lookup(docs.select("doc_id", digest(F.col("text")).alias("digest")), known).select("doc_id", "digest", "license")


def scan_lines(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id and license of every line that is a known text on its own (one row per document and licence).

    Lines are filtered before anything is shuffled: the known table is broadcast while it is small.
    """
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    hits = _lookup(lines.select("doc_id", digest(F.col("line")).alias("digest")), known).where("license is not null")
    return hits.select("doc_id", "license").distinct()



def _sql_canonical(x: str) -> str:
    c = f"' ' || trim(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '{SQL_COPYRIGHT_LINE}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    c = f"replace({c}, ' ', '  ')"
    for variant, form in SPELLINGS:
        c = "replace({}, '{}', '{}')".format(c, *(f" {x} ".replace(" ", "  ")[1:-1] for x in (variant, form)))
    return f"trim(replace({c}, '  ', ' '))"


def oracle() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH known(license, body) AS (VALUES {quoted}),
k AS (SELECT sha256({_sql_canonical("body")}) AS digest, min(license) AS license FROM known GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM d LEFT JOIN k USING (digest)
"""
