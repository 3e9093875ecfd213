"""License scans (operator 7): diagonal voting over rolling word k-grams, in DataFrame functions.

Templates are short declared texts: base phrases, which count exactly, and sentences of public notices, which may be
found in part.  Every pair of neighbouring words of a document is hashed and joined to the templates' pairs by Spark
(the templates are a few hundred fixed rows, so that side is broadcast); the join also compares the words themselves,
so a hash that two pairs share does no harm.  Each match votes for the diagonal word position - template position.
Votes are gathered per document, template and diagonal in the same pass as a bit mask of template places, so that one
word pair that a text repeats is one place however often it stands there.  A base phrase stands at a diagonal that has
all its places.  For a notice every diagonal is merged with those that follow it by at most `slack` (a share of the
notice's length: words may be missing or added), and the merged span is verified: the notice is found if one span holds
at least `cover` of its distinct places.  Such a span is never longer than the notice and its slack, and what stands
around it has no say.  The score is 1 for a base phrase, else the greatest verified cover, else 0.

Cases: a null text is empty; rows that repeat, and null ids, are documents of their own; an empty table gives an empty
result; columns beyond doc_id and text are ignored.  In very long texts, and in those that repeat a template's pair
many times, a merged span is looked at for each diagonal with a vote, over at most `slack` others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let
from plumbline.llm.url_filter import ascii_lower

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: The contract's phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences of public licence notices, by label; none has more than 64 words.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", "to view a copy of this license visit http creativecommons org licenses by 4 0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
}


@dataclass(frozen=True)
class ScanParams:
    cover: float = 0.75
    #: How many words, as a share of the notice's, may be missing or added before a span no longer holds together.
    slack: float = 0.34


def templates(spark: SparkSession) -> DataFrame:
    """A row for each pair of neighbouring template words: gram, template, label, base, place, pairs."""
    rows = []
    said = [(True, label, text) for text, label in PHRASES.items()] + [(False, label, text) for label, texts in NOTICES.items() for text in texts]
    for base, label, text in said:
        ws = text.split()
        rows += [(f"{a} {b}", text, label, base, k, len(ws) - 1) for k, (a, b) in enumerate(zip(ws, ws[1:], strict=False))]
    out = spark.createDataFrame(rows, "gram string, template string, label string, base boolean, place int, pairs int")
    return out.withColumn("hash", F.xxhash64("gram"))


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words and, where there are matches, template, label, base, pairs, diagonal, places (a bit mask)."""
    words = F.regexp_extract_all(ascii_lower_fast(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"), F.lit(1))

    def grams(ws):
        """The pairs with their places and the number of words; place -1 stands for the document itself."""
        n = F.size(ws).cast("long")
        row = lambda pair, pos: F.struct(pair.alias("word_pair"), pos.alias("pos"), n.alias("n_words"))
        rest = F.greatest(F.size(ws) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(ws, 1, rest), F.slice(ws, 2, rest), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(F.array(row(F.lit(None).cast("string"), F.lit(-1))), F.transform(pairs, lambda x, i: row(x, i)))

    # all that is needed lies in the array's elements, so that no row carries the array along
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    pairs = numbered.select("doc_id", "row", F.inline(let(words, grams)))
    t = templates(docs.sparkSession)
    hit = pairs.join(F.broadcast(t), (F.xxhash64("word_pair") == t["hash"]) & (F.col("word_pair") == t["gram"]), "left").where("pos = -1 OR place IS NOT NULL")
    places = F.coalesce(F.bit_or(F.expr("shiftleft(1L, place)")), F.lit(0).cast("long"))
    return hit.groupBy("doc_id", "row", "n_words", "template", "label", "base", "pairs", (F.col("pos") - F.col("place")).alias("diagonal")).agg(places.alias("places"))


def ascii_lower_fast(x):
    """A-Z to a-z and nothing else: translate() of whole texts is slow, so only texts with other letters take it."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(ascii_lower(x))


def covers(v: DataFrame, p: ScanParams) -> DataFrame:
    """v with cover: the share of a template's places on the diagonal, for a notice with those of its span merged in."""
    widest = int(p.slack * max(len(text.split()) - 1 for texts in NOTICES.values() for text in texts))
    following = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, widest)
    span = F.when(~F.col("base"), F.collect_list(F.struct("diagonal", "places")).over(following))
    near = F.filter(span, lambda x: x["diagonal"] - F.col("diagonal") <= F.floor(F.lit(p.slack) * F.col("pairs")))
    merged = F.aggregate(near, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["places"]))
    return v.withColumn("cover", F.bit_count(F.coalesce(merged, F.col("places"))) / F.col("pairs"))


def scan(docs: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    is_base = F.col("base") & (F.col("cover") == 1)
    found = ~F.col("base") & (F.col("cover") >= p.cover)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    at = F.when(is_base, F.col("diagonal")).cast("long")
    return covers(votes(docs), p).groupBy("doc_id", "row", "n_words").agg(
        F.coalesce(F.count(at), F.lit(0)).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        join(is_base).alias("base_labels"), join(is_base | found).alias("labels"), F.coalesce(F.max(F.when(is_base | found, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("row").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
