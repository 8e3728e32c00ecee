"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every text is joined, by its hash, to the positions it has in the
license templates (a fixed table, so it is broadcast; its hashes stand before the join as a runtime filter would).
A match counts if its words are those of the template, not its hash alone.  Matches vote for the diagonal
``text position - template position``; diagonals within SLACK words of each other, as a word
put in or left out makes them, are merged; a merged span is verified if its words cover enough of its
template's words and it is mostly made of them.

Besides, the plain phrases of BASE are counted where their words stand consecutively.

Defined results: a null text counts as empty (no words, no labels, score 0); repeated rows get
equal results each; null ids keep their rows; of several spans of a template in a text, or of several templates of a
label, each counts by itself and ``score`` takes the best, so ties change nothing; very long texts are scanned
whole, and only their matches become rows; other columns are ignored; an empty table gives an empty result.
``score`` is 1 where a phrase of BASE stands, else the largest share of a template's words that a counted span covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_UPPER, expect_columns, stored, text_or_empty

K = 3
SLACK = 3
#: Share of the template's words that a span must have, and share of the span that must be such words.
COVERAGE = 0.6
DENSITY = 0.5
NULL_ID = -(1 << 63)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# License texts, the notices that licenses ask for, and usual one-line forms, by label.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so"
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met"
)
BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_NOTICE = (
    "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
    "as published by the Free Software Foundation"
)
GNU_WARRANTY = (
    ", either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
    "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
)
TEMPLATES = [
    ("mit", MIT_GRANT),
    (
        "mit",
        MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", GNU_NOTICE.format("This program", "")),
    ("gpl", GNU_NOTICE.format("This program", "") + GNU_WARRANTY.format("")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", GNU_NOTICE.format("This library", "Lesser ")),
    ("lgpl", GNU_NOTICE.format("This library", "Lesser ") + GNU_WARRANTY.format("Lesser ")),
    ("agpl", GNU_NOTICE.format("This program", "Affero ")),
    ("agpl", GNU_NOTICE.format("This program", "Affero ") + GNU_WARRANTY.format("Affero ")),
    ("bsd", BSD_CONDITIONS),
    ("bsd", f"{BSD_CONDITIONS}: 1. {BSD_TWO} {BSD_DISCLAIMER}"),
    ("bsd", f"{BSD_CONDITIONS}: 1. {BSD_TWO} {BSD_THIRD} {BSD_DISCLAIMER}"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def lowered(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def starts_of(words: Column, k: int) -> Column:
    """The starts of all rolling k-grams of an array of words."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def kgram_hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def kgram(words: Column, i: Column, k: int) -> Column:
    return F.array_join(F.slice(words, i + 1, k), " ")


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """(template, label, size, tpos, h, gram): the template positions of every k-gram; about a thousand rows."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("t"))
            for n, (label, text) in enumerate(templates or TEMPLATES)
        ]
    )
    words = F.col("words")
    return (
        spark.range(1)
        .select(F.inline(rows))
        .select("template", "label", words_of(lowered(F.col("t"))).alias("words"))
        .select("template", "label", "words", F.size("words").alias("size"), F.explode(starts_of(words, k)).alias("tpos"))
        .select("template", "label", "size", "tpos", kgram_hash(words, F.col("tpos"), k).alias("h"), kgram(words, F.col("tpos"), k).alias("gram"))
    )


def template_matches(words: Column, hashes: list[int], k: int = K) -> Column:
    """The k-grams of an array of words that have one of the hashes: array<struct<pos, h, gram>>."""
    found = F.filter(starts_of(words, k), lambda i: kgram_hash(words, i, k).isin(hashes))
    return F.transform(
        found, lambda i: F.struct(i.alias("pos"), kgram_hash(words, i, k).alias("h"), kgram(words, i, k).alias("gram"))
    )


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, as an array."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + j) == part)
        return test

    return F.filter(starts_of(words, len(parts)), here)


def license_spans(matches: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """Verified spans of ``matches`` (doc_id, text_key, matches): template, label, first_word, last_word (starts of
    k-grams), coverage."""
    votes = (
        matches.where(F.size("matches") > 0)
        .select("doc_id", "text_key", F.inline("matches"))
        # the words are compared too, not their hash alone
        .join(F.broadcast(templates), ["h", "gram"])
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("doc_id", "text_key", "template", "label", "size", "diagonal")
        # a diagonal holds each template position once, so these sets are no longer than a template
        .agg(F.collect_set("pos").alias("places"))
    )
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    runs = votes.withColumn("fresh", F.when(gap <= SLACK, 0).otherwise(1)).withColumn(
        "run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    # every word of a matching k-gram, by its place in the text and in the template
    each = runs.select(
        "doc_id",
        "text_key",
        "template",
        "label",
        "size",
        "run",
        "diagonal",
        F.explode(
            F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: p + j))))
        ).alias("word"),
    )
    merged = each.groupBy("doc_id", "text_key", "template", "label", "size", "run").agg(
        F.count_distinct(F.col("word") - F.col("diagonal")).alias("seen"),
        F.count_distinct("word").alias("here"),
        F.min("word").alias("first_word"),
        (F.max("word") - (k - 1)).alias("last_word"),
    )
    span = F.col("last_word") + k - F.col("first_word")
    return merged.withColumn("coverage", F.col("seen") / F.col("size")).where(
        (F.col("coverage") >= COVERAGE) & (F.col("here") / span >= DENSITY)
    )


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text)."""
    rows = expect_columns(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("text_key"),
        lowered(text_or_empty()).alias("low"),
    )
    table = template_table(docs.sparkSession, templates)
    hashes = sorted(r["h"] for r in table.select("h").distinct().collect())  # a fixed table
    none = F.array().cast("array<int>")
    # every phrase has this word, so most texts need not be searched word by word
    common = set.intersection(*[set(p.split()) for p in BASE])
    worth = F.lit(True)
    for word in sorted(common):
        worth = worth & F.contains(F.col("low"), F.lit(word))
    places = F.concat(*[F.col(f"at_{label}") for label in BASE.values()])
    found = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in BASE.values()]))
    # the one pass over the texts; what it finds is stored, the texts are not
    scanned = stored(
        rows.select("doc_id", "text_key", "low", words_of("low").alias("words"))
        .select(
            "doc_id",
            "text_key",
            F.size("words").cast("long").alias("n_words"),
            template_matches(F.col("words"), hashes).alias("matches"),
            *[F.when(worth, phrase_places(F.col("words"), p)).otherwise(none).alias(f"at_{label}") for p, label in BASE.items()],
        )
        .select(
            "doc_id",
            "text_key",
            "n_words",
            "matches",
            F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"),
            found.alias("found"),
        )
    )
    spans = (
        license_spans(scanned, table)
        .groupBy("doc_id", "text_key")
        .agg(
            F.collect_set("label").alias("more"),
            F.max("coverage").alias("best"),
            F.min("first_word").cast("long").alias("span_first"),
            F.max("last_word").cast("long").alias("span_last"),
        )
    )
    empty = F.array().cast("array<string>")
    return scanned.join(spans, ["doc_id", "text_key"], "left").select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "span_first",
        "span_last",
    )
