"""License scans: MinHash bands over text windows, then exact shingle containment.

Words are runs of letters and digits in lower case; shingles are five words. A text is cut into windows
of eight words that overlap by four, so that each of its shingles starts in exactly one window of four.
A template is cut into such windows at every word. A window's band j is the least of its shingles' j-th
hashes, and a template is retrieved where a band of a text's window equals one of its own.

Bands and chance. A text that holds a template of seven shingles or more has a window whose shingles
are one of the template's windows, which collides for certain. The worst case is a template of a single
shingle: it is one of four in its window, and one of 24 bands then collides with probability
1 - 0.75^24 = 0.999. With two to six shingles there are two windows with better odds each.

A retrieved template is verified exactly: of its shingles, the share that the text holds within a
template's length of the window must reach `threshold`. Of a family of licenses (versions of one, which share most
of their wording) the templates that fit best are reported at each place: a match counts unless better ones
of the family hold all of its shingles, at the same words of the text. What fits elsewhere is reported too.

All is DataFrame expressions. One scan retrieves, without a shuffle but for what it finds; another reads
the documents with hits again to verify them, by a join that broadcasts the hits only while they are small and
deals the texts by id beyond that. The templates' bands are broadcast up to MOST_BANDS rows,
beyond which they are joined by a shuffle.

Defined cases. A null or empty text, or one of fewer than five words, has no match. Rows that share a
doc_id are one document. A template of fewer than five words is refused with a ValueError; equal
templates are all reported. Empty tables give empty ones; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evspark.llm.common import null_safe_text, written

SHINGLE, WINDOW_SHINGLES, BANDS, THRESHOLD = 5, 4, 24, 0.8
#: Rows of template bands (16 bytes each) that are broadcast.
MOST_BANDS = 1_000_000

#: Notices by SPDX identifier, as their licenses word them or as files commonly state them. Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1-or-later", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0-or-later", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    # The headings under which the long licenses stand whole.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    # The short licenses whole.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

#: The part of an identifier that all versions of a license have; of a family, the best fits of a place are told.
FAMILY = "^[A-Za-z]+"

_GAPS = r"[^\p{L}\p{N}]+"


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template (number), license_id, text."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license_id string, text string")


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), _GAPS), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def _bands(shingles: list[Column]) -> Column:
    """The least of the shingles' hashes, for each band; the band's number takes part in it."""
    least = lambda j: F.least(*[F.xxhash64(s, F.lit(j)) for s in shingles])
    return F.array(*[least(j) for j in range(BANDS)])


def _windows(rows: DataFrame, keep: list[str], stride: int) -> DataFrame:
    """keep, at and band of the windows of rows(keep..., words). A window carries its own eight words only:
    rows made by an explode copy all that stands beside it."""
    span = WINDOW_SHINGLES + SHINGLE - 1
    places = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE, F.lit(stride)))
    cut = rows.select(*keep, F.explode(F.transform(places, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, F.lit(span)).alias("w")))).alias("x"))
    # A place beyond the last shingle stands for the first of the window, which changes no least hash.
    first = F.size("x.w") - SHINGLE
    shingles = [F.when(F.lit(k) <= first, _shingle(F.col("x.w"), F.lit(k))).otherwise(_shingle(F.col("x.w"), F.lit(0))).alias(f"s{k}") for k in range(WINDOW_SHINGLES)]
    cut = cut.select(*keep, "x.at", *shingles)
    return cut.select(*keep, "at", F.explode(_bands([F.col(f"s{k}") for k in range(WINDOW_SHINGLES)])).alias("band"))


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, license_id, n_shingles, matched and at (word of the first window that found it)
    for each template that a document of docs(doc_id, text) holds."""
    known = templates.select("template", "license_id", _word_hashes(null_safe_text()).alias("words"))
    if known.filter(F.size("words") < SHINGLE).limit(1).count():
        raise ValueError(f"a template needs {SHINGLE} words")
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda p: _shingle(F.col("words"), p)))
    known = written(known.withColumn("wanted", every).withColumn("length", F.size("words")), "templates")
    # A template of fewer shingles than a window has is one window.
    ends = F.greatest(F.col("length") - SHINGLE - WINDOW_SHINGLES + 1, F.lit(0))
    bands = written(_windows(known, ["template", "words", "length"], 1).filter(F.col("at") <= ends).select("template", "band").distinct(), "bands")
    small = bands.count() <= MOST_BANDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _word_hashes(null_safe_text()).alias("words"))
    hits = _windows(rows, ["doc_id"], WINDOW_SHINGLES).join(F.broadcast(bands) if small else bands, "band").select("doc_id", "template", "at").distinct()
    about = known.select("template", "license_id", "wanted", "length")
    # A template's shingles stand in a document's row once, however often it is hit: places are all that adds up.
    hits = hits.groupBy("doc_id", "template").agg(F.collect_set("at").alias("ats")).join(F.broadcast(about) if small else about, "template")
    hits = written(hits.groupBy("doc_id").agg(F.collect_list(F.struct("template", "license_id", "ats", "length", "wanted")).alias("hits")), "hits")

    def verified(h: Column, at: Column) -> Column:
        low, high = F.greatest(at - h["length"], F.lit(0)), F.least(at + h["length"], F.size("words") - SHINGLE)
        near = F.transform(F.sequence(low, high), lambda p: F.struct(_shingle(F.col("words"), p).alias("s"), F.xxhash64("tag", p).alias("p")))
        held = F.filter(near, lambda x: F.array_contains(h["wanted"], x["s"]))
        matched = F.size(F.array_distinct(F.transform(held, lambda x: x["s"]))).cast("long")
        return F.struct(h["template"].alias("template"), h["license_id"].alias("license_id"), at.alias("at"), F.size(h["wanted"]).cast("long").alias("n_shingles"), matched.alias("matched"), F.transform(held, lambda x: x["p"]).alias("places"))

    same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text")).join(hits, "doc_id").select("doc_id", "hits", F.xxhash64("text").alias("tag"), _word_hashes(F.col("text")).alias("words"))
    # Of rows that share a doc_id, one may be too short for another's hit.
    able = lambda h: F.filter(h["ats"], lambda at: F.greatest(at - h["length"], F.lit(0)) <= F.size("words") - SHINGLE)
    found = same.select("doc_id", F.explode(F.flatten(F.transform("hits", lambda h: F.transform(able(h), lambda at: verified(h, at))))).alias("v")).select("doc_id", "v.*")
    found = found.filter(F.col("matched") >= F.lit(threshold) * F.col("n_shingles"))
    fits = found.groupBy("doc_id", "template", "license_id", "n_shingles", "matched").agg(F.min("at").alias("at"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    # Versions of a license differ by a word or two; the wording that fits a place best tells which it is.
    fits = fits.withColumn("share", F.col("matched") / F.col("n_shingles"))
    family = Window.partitionBy("doc_id", F.regexp_extract("license_id", FAMILY, 0))
    fits = fits.withColumn("_rivals", F.collect_list(F.struct("share", "places")).over(family))
    better = F.flatten(F.transform(F.filter("_rivals", lambda r: r["share"] > F.col("share")), lambda r: r["places"]))
    left = fits.filter(F.size(F.array_except("places", better)) > 0)
    return left.groupBy("doc_id", "template", "license_id", "n_shingles").agg(F.max("matched").alias("matched"), F.min("at").alias("at"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the containment of templates in documents, by plain shingles."""
    rows = ", ".join("(%d, '%s', '%s')" % (i, a, b.replace("'", "''")) for i, (a, b) in enumerate(templates))
    cut = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, license_id, text)),
tw AS (SELECT template, license_id, {cut} AS w FROM t),
ts AS (SELECT DISTINCT template, license_id, w[i:i+4] AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT template, count(*) AS n_shingles FROM ts GROUP BY 1),
dw AS (SELECT doc_id, {cut} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, w[i:i+4] AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
f AS (
  SELECT doc_id, template, license_id, n_shingles, count(*) AS matched
  FROM ds JOIN ts USING (s) JOIN tn USING (template)
  GROUP BY ALL HAVING count(*) >= {threshold} * n_shingles)
SELECT * FROM f
QUALIFY matched / n_shingles = max(matched / n_shingles) OVER (PARTITION BY doc_id, regexp_extract(license_id, '{FAMILY}'))"""
