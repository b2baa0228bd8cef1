"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is scanned as a whole, by its paragraphs (between blank lines) and by its
lines. Each unit is lower-cased, reduced to words of letters and digits, and
compared to every template whose number of bigrams lies within the bounds that
the least Dice value allows: 2 c / (n + m) >= t with c <= min(n, m) needs
t m / (2 - t) <= n <= (2 - t) m / t.

A licence may also stand across several paragraphs or within a longer line. So all
windows of neighbouring words are scanned too, between any two bigrams that a
template holds, up to twice the upper bound in words; only a bigram that the template
does not hold adds to a window's size each time it recurs. A document has at most one window match per
licence, and only if no unit matches that licence and the window does not lie within
one of a larger total.

Defined results: a null or empty text matches nothing; a unit of one word has that
word as its only bigram; ties go to the larger total, then to the last name;
documents are told apart by doc_id, repeated rows count once; an empty table gives
an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, stored

LEAST = 0.8

# The notices and grants that projects publish under these licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "All rights reserved": "All rights reserved.",
}


def normal_words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_pairs(h: Column) -> Column:
    """Hash of every two neighbouring words, in order."""
    n = F.size(h)
    return F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def bigrams(text: Column) -> Column:
    """Distinct hashes of neighbouring words."""
    of = lambda h: F.when(F.size(h) == 1, h).otherwise(F.array_distinct(word_pairs(h)))
    return let(F.transform(normal_words(text), lambda w: F.xxhash64(w)), of)


def units(docs: DataFrame) -> DataFrame:
    """doc_id, kind, unit_no, n, gram of every scanned unit; units of one line that is a whole paragraph or text count once."""
    text = F.col("text")
    numbered = lambda kind, c: F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit_no"), x.alias("unit")))
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    parts = F.concat(
        numbered("line", F.split(text, "\n")),
        F.when(F.size(paragraphs) > 1, numbered("paragraph", paragraphs)).otherwise(F.array()),
        F.when(F.contains(text, F.lit("\n")), numbered("text", F.array(text))).otherwise(F.array()),
    )
    return docs.where(text.isNotNull()).select("doc_id", F.explode(parts).alias("u")).select("doc_id", "u.*")


def template_grams(docs: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """license, m, gram: the bigrams of every template."""
    named = docs.sparkSession.createDataFrame(sorted(templates.items()), "license string, body string")
    return named.select("license", bigrams(F.col("body")).alias("g")).select("license", F.size("g").alias("m"), F.explode("g").alias("gram"))


def matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, kind, unit_no, license, shared, total: units that reach the least Dice value 2 shared / total.

    The table of templates is a fixed list, so its bigrams are broadcast. Bigrams
    that no template of fitting size holds end in the map task; the others are
    counted before the shuffle.
    """
    grams = template_grams(docs, templates)
    most = max(1, max(len(body.split()) * 2 for body in templates.values()))
    top = int(most * (2 - least) / least) + 1
    scanned = (
        units(docs)
        .withColumn("g", bigrams(F.col("unit")))
        .withColumn("n", F.size("g"))
        .where((F.col("n") > 0) & (F.col("n") <= top))
        .select("doc_id", "kind", "unit_no", "n", F.explode("g").alias("gram"))
    )
    n, m = F.col("n"), F.col("m")
    fits = (n * (2 - least) >= m * least) & (n * least <= m * (2 - least))
    hits = scanned.join(F.broadcast(grams), "gram").where(fits)
    counted = hits.groupBy("doc_id", "kind", "unit_no", "license", "n", "m").agg(F.countDistinct("gram").alias("shared"))
    total = (n + m).cast("long").alias("total")
    return counted.where(2 * F.col("shared") >= least * (n + m) - 1e-9).select("doc_id", "kind", "unit_no", "license", "shared", total)


def windows(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, text_id, license, start, end, shared, total: for each first bigram the best window that reaches the least Dice value.

    Only bigrams of a template are shuffled, and a template with too few of them in a text ends there.
    """
    text, m = F.col("text"), F.col("m")
    pairs = let(F.transform(normal_words(text), lambda w: F.xxhash64(w)), word_pairs)
    placed = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("text_id"), F.posexplode(pairs).alias("pos", "gram"))
    hits = placed.join(F.broadcast(template_grams(docs, templates)), "gram")
    held = hits.groupBy("doc_id", "text_id", "license", "m").agg(F.collect_set(F.struct("gram", "pos")).alias("h"))
    enough = F.size(F.array_distinct(F.transform("h", lambda x: x["gram"]))) * (2 - least) >= m * least - 1e-9

    def ordered(h: Column) -> Column:
        """(pos, prev) by pos; prev is the place before at which the bigram occurs, or -1."""
        return F.sort_array(
            F.transform(h, lambda x, i: F.struct(x["pos"].alias("pos"), F.when(F.get(h, i - 1)["gram"] == x["gram"], F.get(h, i - 1)["pos"]).otherwise(-1).alias("prev")))
        )

    top = F.floor(m * ((2 - least) / least) + 1e-9).cast("int")

    def best(h: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            after = F.transform(F.slice(h, i + 1, 2 * top), lambda y, k: F.struct(y["pos"].alias("pos"), y["prev"].alias("prev"), k.alias("k")))
            new = F.filter(after, lambda y: (y["prev"] < x["pos"]) & (y["pos"] < x["pos"] + 2 * top))

            def ends(y: Column, j: Column) -> Column:
                # The window's places, without the repeats among the hits.
                total = (y["pos"] - x["pos"] + 1 - (y["k"] - j) + m).cast("long")
                return F.struct(((j + 1) / total).alias("dice"), total.alias("total"), x["pos"].alias("start"), y["pos"].alias("end"), (j + 1).cast("long").alias("shared"))

            return F.array_max(F.transform(new, ends))

        return F.filter(F.transform(h, of), lambda w: 2 * w["shared"] >= least * w["total"] - 1e-9)

    rows = held.where(enough).withColumn("h", let(F.sort_array("h"), ordered)).select("doc_id", "text_id", "license", F.explode(let(F.col("h"), best)).alias("w"))
    return rows.select("doc_id", "text_id", "license", "w.start", "w.end", "w.shared", "w.total")


def all_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The matches of units, and the best window of each licence that no unit of the document matches."""
    whole = stored(matches(docs, templates, least), "license_units")
    spans = stored(windows(docs, templates, least), "license_windows")
    known = whole.select(F.col("doc_id").alias("_id"), F.col("license").alias("_license")).distinct()
    rest = spans.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("license") == F.col("_license")), "left_anti")
    longer = spans.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), *[F.col(c).alias(f"_{c}") for c in ("start", "end", "total")])
    inside = (F.col("_start") <= F.col("start")) & (F.col("end") <= F.col("_end")) & (F.col("total") < F.col("_total"))
    rest = rest.join(longer, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text")) & inside, "left_anti")
    order = F.struct((F.col("shared") / F.col("total")).alias("dice"), "total", "shared")
    one = rest.groupBy("doc_id", "license").agg(F.max(order).alias("w")).select("doc_id", F.lit("window").alias("kind"), F.lit(0).alias("unit_no"), "license", "w.shared", "w.total")
    both = stored(whole.unionByName(one), "license_matches")
    discard(whole, spans)
    return both


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, shared, total, n_matches of the best match: one row per doc_id, nulls and 0 without a match."""
    found = all_matches(docs, templates, least)
    order = F.struct(
        (F.col("shared") / F.col("total")).alias("dice"), F.col("total").alias("total"), F.col("license").alias("license"), F.col("shared").alias("shared"),
    )
    best = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n"))
    ids = docs.select("doc_id").distinct()
    return ids.join(best, ids["doc_id"].eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("best.license").alias("license"), F.col("best.shared").alias("shared"), F.col("best.total").alias("total"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
    )
