"""License scan by diagonal voting, in DataFrame expressions only.

Every pair of neighbouring words of every text is hashed and joined to the pairs of the license
templates (a fixed table, broadcast); the words of a match are compared too. A match at word p of the
text and place t of the template votes for the diagonal p - t, which is where the template would
start. Votes are gathered by text, template and diagonal. A template stands word for word where its
diagonal has all votes; this is how the phrases of the base list are found. Of the longer templates'
other diagonals, neighbouring ones are merged, as words put in or left out move a match to a neighbouring diagonal:
all that lie between any two diagonals that are at most a share of the template's length (or SLACK) apart, wherever
they start, so that no stray match before or after a license moves its span.
A merged span is verified: the words that match must be COVERAGE of the template's words, and as much
of the text's words from the first of them to the last. Spans without half as many votes are not looked at.

Defined results: a null or empty text has no words and no labels; repeated rows are scanned one by
one; templates of one label, or at one place, each count, and the score is the best one's; a text of
any length is scanned whole, and only its matches are grouped; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import cut
from tidemark.llm.text import letter_words, whole_text

SLACK = 3
#: A template of n words may stretch by n / STRETCH words.
STRETCH = 5
COVERAGE = 0.8
#: The phrases and labels of the base scan.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Texts, openings and notices of public licenses, as words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)


def rows_of_templates() -> list[tuple[int, str, str, bool]]:
    """(template, label, text, exact) of the phrases and the templates."""
    return [(i, label, text, exact) for i, (label, text, exact) in enumerate([(*p, True) for p in PHRASES] + [(*t, False) for t in TEMPLATES])]


def _templates(spark: SparkSession) -> DataFrame:
    """(gram, a, b, template, place, size, label, exact), one row a pair a, b of neighbouring words."""
    words = spark.createDataFrame(rows_of_templates(), "template int, label string, text string, exact boolean").withColumn("w", F.split("text", " "))
    pairs = words.select("template", "label", "exact", (F.size("w") - 1).alias("size"), F.posexplode(F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> struct(xxhash64(x, w[i + 1]) AS gram, x AS a, w[i + 1] AS b))")).alias("place", "pair"))
    return F.broadcast(pairs.select("template", "label", "exact", "size", "place", "pair.*"))  # some hundred rows


def votes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, ..., diagonal, places): a row for each diagonal, and one with null template for each text."""
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), letter_words(whole_text(F.col("text"))).alias("w"))
    grams = words.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.expr("transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> struct(xxhash64(x, w[i + 1]) AS gram, x AS c, w[i + 1] AS d))").alias("grams"))
    each = grams.select("doc_id", "row", "n_words", F.posexplode_outer("grams").alias("p", "pair")).select("doc_id", "row", "n_words", "p", "pair.*")
    known = _templates(docs.sparkSession).withColumnRenamed("gram", "known")
    same = (F.col("gram") == F.col("known")) & (F.col("a") == F.col("c")) & (F.col("b") == F.col("d"))
    matched = each.join(known, same, "left").where("template is not null or coalesce(p, 0) = 0")
    diagonal = (F.col("p") - F.col("place")).cast("long")
    return matched.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "size", diagonal.alias("diagonal")).agg(F.collect_list("place").alias("places"))


def _reach(size: Column) -> Column:
    """How far apart the diagonals of one span may be."""
    return F.greatest(F.lit(SLACK), F.floor(size / STRETCH)).cast("long")


def _windows(loose: DataFrame) -> DataFrame:
    """(row, template, low, high): diagonals of a text that are within reach, with enough votes between them to cover a template."""
    need = COVERAGE * (F.col("size") + 1) / 2
    most = max(SLACK, *[(len(text.split()) - 1) // STRETCH for _, text in TEMPLATES])
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    n = F.size("places")
    # Votes up to the farthest reach of any template tell where a span may begin and end.
    near = loose.withColumns({"n": n, "up": F.sum(n).over(by.rangeBetween(0, most)), "down": F.sum(n).over(by.rangeBetween(-most, 0)), "so_far": F.sum(n).over(by)}).where((F.col("up") >= need) | (F.col("down") >= need))
    listed = near.groupBy("row", "template", "size").agg(F.array_sort(F.collect_list(F.struct("diagonal", "so_far", "n", (F.col("down") >= need).alias("ends")))).alias("d"))
    pairs = listed.select("row", "template", "size", F.explode("d").alias("low"), "d").select("row", "template", "low", F.explode(F.filter("d", lambda x: x["ends"] & x["diagonal"].between(F.col("low.diagonal"), F.col("low.diagonal") + _reach(F.col("size"))) & (x["so_far"] - F.col("low.so_far") + F.col("low.n") >= need))).alias("high"))
    return pairs.select("row", "template", F.col("low.diagonal").alias("low"), F.col("high.diagonal").alias("high"))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans of a stored table of votes(), with `start` and `score`; and rows with null score, so that no text is lost."""
    whole = F.size("places") == F.col("size")
    verbatim = voted.withColumns({"start": F.col("diagonal"), "score": F.when(whole, F.lit(1.0))})
    loose = voted.where(~F.col("exact") & ~whole)
    met = loose.join(_windows(loose), ["row", "template"]).where("diagonal between low and high")
    pairs = met.select("row", "doc_id", "n_words", "template", "label", "exact", "size", "low", "high", "diagonal", F.explode("places").alias("place")).withColumn("p", F.col("place") + F.col("diagonal"))
    merged = pairs.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "size", "low", "high").agg(F.collect_set("place").alias("places"), F.collect_set("p").alias("at"), (F.max("p") - F.min("p") + 2).alias("stretch"))
    # The words of a pair at x are x and x + 1.
    covered = lambda c: F.size(F.array_union(c, F.transform(c, lambda x: x + 1)))
    share = covered("places") / (F.col("size") + 1)
    verified = (share >= COVERAGE) & (covered("at") >= COVERAGE * F.col("stretch"))
    scored = merged.withColumns({"start": F.col("low"), "score": F.when(verified, share)}).where("score is not null")
    # Of spans of one license the best, of equal ones the shortest, then the first.
    by = Window.partitionBy("row", "template")
    apart = F.col("low") - F.lag("low").over(by.orderBy("low", "high")) > _reach(F.col("size"))
    parted = scored.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("chain", F.sum("new").over(by.orderBy("low", "high")))
    best = F.row_number().over(Window.partitionBy("row", "template", "chain").orderBy(F.desc("score"), F.col("high") - F.col("low"), "low"))
    same = ["row", "doc_id", "n_words", "label", "exact", "start", "score"]
    return verbatim.select(same).unionByName(parted.withColumn("best", best).where("best = 1").select(same))


def scan(docs: DataFrame) -> DataFrame:
    """One row a text: n_words, n_base, first_word, last_word, base_labels, labels and score."""
    hit = F.col("score").isNotNull()
    base = hit & F.col("exact")
    named = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        spans(cut(votes(docs)))
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            named(base).alias("base_labels"),
            named(hit).alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
