"""License scans by diagonal voting, in DataFrame functions only.

Every word k-gram of every document is joined to the grams of the templates by the hash of its first two
words and held against all its words: pairs for phrases and notices, grams of LONG_GRAM words for whole
licence texts, where single pairs would hit by chance. A hit at word p of the document and place t of the
template votes for the diagonal p - t. Neighbouring diagonals (inserted or missing words) merge: from
each diagonal, those up to the template's shift beyond it, which grows with its length up to MAX_SHIFT.
So a span is never longer than its template and shift, and it is verified by the share of the template's
grams it holds. Phrases must be whole and unbroken. The templates are a fixed list, so their side of the
join is broadcast; a document's words are never shuffled, only its hits.

Defined cases: null text is empty and gets no label; repeated rows are scanned as rows of their own;
rows without a hit come out with empty labels; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, written

#: Phrases, their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening words of public licence texts and notices, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
}
#: Licence texts as published, in lower-case words.
WHOLE = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
LONG_GRAM = 4
#: Words inserted or left out that a span may have: 2 for short templates, more for longer ones.
MAX_SHIFT = 8
LEAST_SCORE = 0.8
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, WORD_GAP), lambda w: w != "")


def template_grams(templates: dict[str, str] | None = None, whole: dict[str, str] | None = None) -> list[tuple]:
    """(w1, w2, w3, w4, template, label, phrase, place, grams, shift): one row per template gram; w3 and w4 are null in pairs."""
    listed = [(text, label, True, 2) for text, label in PHRASES.items()]
    listed += [(text, label, False, 2) for label, text in (TEMPLATES if templates is None else templates).items()]
    listed += [(text, label, False, LONG_GRAM) for label, text in (WHOLE if whole is None else whole).items()]
    rows = []
    for number, (text, label, phrase, k) in enumerate(listed):
        words = text.split()
        n = len(words) - k + 1
        shift = 0 if phrase else min(MAX_SHIFT, 2 + n // 16)
        rows += [(*words[at : at + k], *[None] * (LONG_GRAM - k), number, label, phrase, at, n, shift) for at in range(n)]
    return rows


def scan(docs: DataFrame, templates: dict[str, str] | None = None, whole: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows of (_row, doc_id, n_words); spans of (_row, label, phrase, first_word, score)."""
    spark = docs.sparkSession

    def cut(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(i.alias("pos"), *[F.get(w, i + k).alias(f"g{k + 1}") for k in range(LONG_GRAM)]))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) > 1, grams).alias("grams"))

    cuts = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", let(license_words(F.col("text")), cut).alias("c"))
    grams = spark.createDataFrame(template_grams(templates, whole), "w1 string, w2 string, w3 string, w4 string, template int, label string, phrase boolean, place int, grams int, shift int")
    grams = F.broadcast(grams.withColumn("pair", F.xxhash64("w1", "w2")))  # a fixed list
    rolled = cuts.select("_row", "doc_id", F.col("c.n_words").alias("n_words"), F.explode_outer("c.grams").alias("p"))
    # the first gram of each document stays as the document's own row, whether it hits or not
    alike = (F.col("p.g1") == F.col("w1")) & (F.col("p.g2") == F.col("w2")) & (F.col("w3").isNull() | (F.col("p.g3") == F.col("w3")) & (F.col("p.g4") == F.col("w4")))
    hits = rolled.join(grams, (F.xxhash64("p.g1", "p.g2") == F.col("pair")) & alike, "left")
    hits = hits.where(F.col("template").isNotNull() | F.col("p").isNull() | (F.col("p.pos") == 0))
    hits = written(hits.select("_row", "doc_id", "n_words", F.col("p.pos").alias("pos"), "template", "label", "phrase", "place", "grams", "shift"), "license-hits")
    rows = hits.where(F.col("pos").isNull() | (F.col("pos") == 0)).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    votes = hits.where(F.col("template").isNotNull()).withColumn("diagonal", F.col("pos") - F.col("place"))
    votes = votes.groupBy("_row", "template", "label", "phrase", "grams", "shift", "diagonal").agg(F.collect_set("place").alias("places"), F.min("pos").alias("first_word"))
    # from each diagonal, those within the template's shift; their places count once
    ahead = Window.partitionBy("_row", "template").orderBy("diagonal").rangeBetween(Window.currentRow, MAX_SHIFT)
    near = F.filter(F.collect_list(F.struct("diagonal", "places")).over(ahead), lambda x: x["diagonal"] <= F.col("diagonal") + F.col("shift"))
    merged = votes.withColumn("near", near)
    spans = merged.select("_row", "label", "phrase", "first_word", (F.size(F.array_distinct(F.flatten(F.col("near.places")))) / F.col("grams")).alias("score"))
    return rows, spans.where(F.when(F.col("phrase"), F.col("score") == 1).otherwise(F.col("score") >= LEAST_SCORE))


def labelled(docs: DataFrame, templates: dict[str, str] | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    rows, spans = scan(docs, templates, whole)
    base = F.col("phrase")
    per = spans.groupBy("_row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    joined = rows.join(per, "_row", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
