"""Licence scan by canonical digests.

A text and a known licence are brought to one form: lower case, no copyright lines, one of
each group of equivalent spellings, words only.  The form's digest is looked up in the table
of known digests by a hash join.  Entire texts are looked up; the units are the whole
document, its paragraphs (if a blank line parts it), its passages and its lines (if more than one), so that a licence or
notice which makes up a part of a document is found too, each as an entire text of its own.  A passage is a run of
paragraphs, not all of the document, which are those of a known text of several paragraphs in order; its digest is that of the
paragraphs' digests, made only where a paragraph is the first one of such a text.

The known table is a setting
(NOTICES, some dozens of rows) and is broadcast, so no text is shuffled and a very common
notice is no hot key; what is grouped are the matches.

Defined cases: a null or empty text has no unit with words, so no match and no row; a
unit of punctuation or copyright lines only is no unit and parts no passage; rows
equal in the kept columns count together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_ROWS

# Public licence names and the notices and texts that stand for them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
NOTICES = (
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("reserved", "All rights reserved."),
)
# Spellings that mean the same, the second one kept; on words between single spaces.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"), ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"),
    ("v2", "version 2"), ("v3", "version 3"), ("apache2", "apache 2"), ("gplv3", "gpl version 3"),
)
BLANK = r"\n[ \t]*\n+"
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[ \t]+(\(c\)|©|[0-9]|by )|\(c\)[ \t]*[0-9]|©)[^\n]*$"


def plain(text: Column) -> Column:
    """Lower case, no lines that begin with a copyright mark, words between single spaces."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def spelled(form: Column) -> Column:
    """One of each group of equivalent spellings."""
    t = F.concat(F.lit(" "), form, F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(t)


def digests(forms: Column, reach: int | None = None) -> Column:
    """Digest of each form; '' for no words or more than `reach` characters."""
    def digest(form: Column) -> Column:
        fits = form != "" if reach is None else F.length(form).between(1, reach)
        return F.when(fits, F.md5(spelled(form))).otherwise("")
    return F.transform(forms, digest)


def paragraphs(text: Column) -> Column:
    """Forms of the paragraphs that have words."""
    return F.filter(F.transform(F.split(text, BLANK, -1), plain), lambda form: form != "")


def joined(parts: Column) -> Column:
    """Digest of a passage from those of its paragraphs."""
    return F.md5(F.concat_ws(" ", parts))


def passages(parts: Column, texts: list[list[str]]) -> Column:
    """Digests of the runs of paragraphs that begin like one of the texts, as long as it and shorter than the document."""
    if not texts:
        return F.array().cast("array<string>")
    firsts, lengths = sorted({t[0] for t in texts}), sorted({len(t) for t in texts})
    n = F.size(parts)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, i).isin(firsts))
    runs = F.transform(starts, lambda i: F.array(*[
        F.when((i + k <= n) & (n > k), joined(F.slice(parts, i + 1, k))) for k in lengths]))
    return F.when(n > 1, F.array_compact(F.flatten(runs)))


def known(spark, notices=NOTICES) -> DataFrame:
    """(digest, license, parts, size) of the known texts; parts are the digests of a passage's paragraphs, else null."""
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in notices])
    d = spark.range(1).select(F.inline(rows)).filter(plain(F.col("text")) != "")
    d = d.select("license", F.length(spelled(plain(F.col("text")))).alias("size"), F.element_at(digests(F.array(plain(F.col("text")))), 1).alias("whole"), digests(paragraphs(F.col("text"))).alias("parts"))
    texts = d.select(F.col("whole").alias("digest"), "license", "size", F.lit(None).cast("array<string>").alias("parts"))
    runs = d.filter(F.size("parts") > 1).select(joined(F.col("parts")).alias("digest"), "license", "size", "parts")
    return texts.union(runs).groupBy("digest").agg(F.min("license").alias("license"), F.first("parts").alias("parts"), F.max("size").alias("size"))


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), notices=NOTICES) -> DataFrame:
    """One row per document, kind of unit and licence found: the kept columns, unit, license, n (units that match).

    A kept column of one of the last three names is left out.
    """
    t, p = F.col("_text"), F.col("_paragraphs")
    table = known(docs.sparkSession, notices)
    found = table.collect()  # some dozens of digests
    texts = [r.parts for r in found if r.parts]
    # a spelling shortens a form by half at most, so a longer form is no known text
    reach = 2 * max((r.size for r in found), default=0)
    units = F.array(
        F.struct(F.lit("text").alias("unit"), digests(F.array(plain(t)), reach).alias("digests")),
        F.struct(F.lit("paragraph").alias("unit"), p.alias("digests")),
        F.struct(F.lit("passage").alias("unit"), passages(p, texts).alias("digests")),
        F.struct(F.lit("line").alias("unit"), F.when(t.contains("\n"), digests(F.transform(F.split(t, "\n", -1), plain), reach)).alias("digests")))
    keep = [c for c in keep if c.lower() not in ("unit", "license", "n")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    looked = (docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text")).filter("_text is not null")
              .select("_row", "_text", F.when(t.rlike(BLANK), digests(paragraphs(t), reach)).alias("_paragraphs"))
              .select("_row", F.inline(units)).select("_row", "unit", F.explode("digests").alias("_digest")))
    table = table.select("digest", "license")
    hits = looked.join(table.hint("broadcast" if len(found) <= BROADCAST_ROWS else "merge"), F.col("_digest") == F.col("digest"))
    return hits.groupBy("_row", "unit", "license").agg(F.count("*").alias("n")).select(*[F.col("_row")[c].alias(c) for c in keep], "unit", "license", "n")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op6_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        t = f"regexp_replace(lower({x}), {quoted(COPYRIGHT)}, ' ', 'g')"
        t = rf"regexp_replace(replace({t}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        t = f"' ' || trim({t}) || ' '"
        for old, new in SPELLINGS:
            t = f"replace({t}, ' {old} ', ' {new} ')"
        return f"trim({t})"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in NOTICES)
    return f"""
with known as (select md5({form('t')}) as digest, min(license) as license from (values {values}) v(license, t) group by 1),
parts as (select doc_id, 'text' as unit, text as part from documents where text is not null
 union all select doc_id, 'paragraph', unnest(regexp_split_to_array(text, {quoted(BLANK)})) from documents where regexp_matches(text, {quoted(BLANK)})
 union all select doc_id, 'line', unnest(string_split(text, chr(10))) from documents where contains(text, chr(10))),
forms as (select doc_id, unit, {form('part')} as form from parts)
select doc_id, unit, license, count(*) as n from forms join known on digest = md5(form) where form != '' group by all
"""
