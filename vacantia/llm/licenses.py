"""License scans by diagonal voting.

Every run of ``k`` words of a document that also stands in a template votes for the diagonal
``place in the document - place in the template``. A copy of the template lies on one diagonal;
inserted and lost words move the rest of it to a neighbouring one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in a row that vote together. The shortest template has this many words at least.
K = 3
#: Template places up to which the template table is broadcast; a longer one is joined by shuffle.
BROADCAST_PLACES = 200_000


@dataclass(frozen=True)
class Template:
    """A phrase (``phrase``: only word for word) or a longer text, which may differ in places."""

    label: str
    text: str
    phrase: bool = False


# The phrases of the contract with their labels.
PHRASES = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
)

# Usual notices of public licenses.
NOTICES = (
    Template("gpl-3", "gnu general public license version 3", phrase=True),
    Template("gpl-2", "gnu general public license version 2", phrase=True),
    Template("lgpl", "gnu lesser general public license", phrase=True),
    Template("mpl-2", "mozilla public license v 2 0", phrase=True),
    Template("cc-by", "creative commons attribution 4 0 international license", phrase=True),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", phrase=True),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", phrase=True),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies."""),
)

#: Share of a text's words that have to be found, and of the found span that has to be the text's.
LEAST_SHARE = 0.8
#: Words by which neighbouring diagonals of one copy may lie apart.
SLACK = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words: runs of digits, letters a-z after lower-casing A-Z, and everything beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), "")


def _grams(found: Column, k: int) -> Column:
    """The k words from each place on; the last k - 1 places hold fewer and match no template."""
    return F.transform(found, lambda w, i: F.concat_ws(" ", w, *[F.get(found, i + n) for n in range(1, k)]))


def template_places(spark: SparkSession, templates: Sequence[Template], k: int = K) -> DataFrame:
    """``(template, gram, at)``: every run of k words of every template; and their number per template."""
    rows = spark.createDataFrame([(n, t.text) for n, t in enumerate(templates)], "template int, text string")
    placed = rows.select("template", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    return placed.select("template", "n", F.posexplode(F.slice(_grams(F.col("w"), k), 1, F.col("n") - k + 1)).alias("at", "gram"))


def _covered(places: Column, k: int) -> Column:
    """Template words under runs of k that start at the sorted places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(state: Column, at: Column) -> Column:
        return F.struct((state["n"] + at + k - F.greatest(at, state["end"])).alias("n"), (at + k).alias("end"))

    return F.aggregate(places, start, step, lambda s: s["n"])


def scan(
    documents: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, k: int = K,
    slack: int = SLACK, least: float = LEAST_SHARE,
) -> DataFrame:
    """``(doc_id, n_words, best, spans)`` per document.

    ``spans`` lists the verified copies in document order: template number, first and last word (from
    0) and the share of the template found. ``best`` is the largest share found of any template, also
    where it was not enough. The whole text is read; NULL counts as empty. Rows that repeat an id and
    a text are one group while votes are counted and come out as often as they went in; equal ids
    with different texts stay apart, NULL ids too. Other columns are not read.

    One scan: the runs of a document meet the template table in a join on their hash, checked word by
    word, and only hits leave the task, combined per (document, template, diagonal). A group holds
    hits of one document; what all documents share costs a hit in each, never a pair of documents.
    """
    spark = documents.sparkSession
    parts = template_places(spark, templates, k)
    sizes = [r["n"] for r in parts.select("template", "n").distinct().orderBy("template").collect()]
    if len(sizes) < len(templates):
        raise ValueError(f"a template has fewer than {k} words")
    # One vote that no template casts carries each document through, with its number of words.
    mark = len(templates)
    places = parts.select("template", "at", "gram").union(
        spark.range(1).select(F.lit(mark).alias("template"), F.lit(0).alias("at"), F.lit("").alias("gram")))
    places = places.select("template", "at", F.col("gram").alias("template_gram"), F.xxhash64("gram").alias("h"))
    if sum(sizes) <= BROADCAST_PLACES:
        places = F.broadcast(places)
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select("doc_id", F.xxhash64(text).alias("key"), words(text).alias("w"))
    runs = split.select(
        "doc_id", "key", F.size("w").cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), _grams(F.col("w"), k))).alias("place", "gram"),
    ).withColumn("h", F.xxhash64("gram"))
    hits = runs.join(places, "h").filter(F.col("gram") == F.col("template_gram")).select(
        "doc_id", "key", "n_words", "template", "at", (F.col("place") - 1).alias("place"))
    diagonals = hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(
        "doc_id", "key", "template", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("first"), (F.max("place") + k - 1).alias("last"),
        F.count(F.lit(1)).alias("votes"), F.max("n_words").alias("n_words"),
    )
    apart = F.when(_of(templates, lambda t, _: t.phrase), F.lit(0)).otherwise(slack)
    in_order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(in_order) > apart
    numbered = diagonals.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn(
        "copy", F.sum("far").over(in_order))
    copies = numbered.groupBy("doc_id", "key", "template", "copy").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("votes").alias("votes"), F.max("n_words").alias("n_words"),
    )
    size = _of(templates, lambda _, n: sizes[n])
    found = _covered(F.col("ats"), k)
    judged = copies.withColumn("share", found / size).withColumn("dense", found / (F.col("last") - F.col("first") + 1))
    limit = F.when(_of(templates, lambda t, _: t.phrase), F.lit(1.0)).otherwise(least)
    is_mark = F.col("template") == mark
    right = ~is_mark & (F.col("share") >= limit) & (F.col("dense") >= limit)
    span = F.struct("first", "last", "template", "share")
    return judged.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.max(F.when(~is_mark, F.col("share"))), F.lit(0.0)).alias("best"),
        F.sort_array(F.collect_list(F.when(right, span))).alias("spans"),
        F.max(F.when(is_mark, F.col("votes"))).alias("_rows"),
    ).select(
        "doc_id", "n_words", "best", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_row")
    ).drop("_row")


def _of(templates: Sequence[Template], value) -> Column:
    """A value of the row's template."""
    values = F.array(*[F.lit(value(t, n)) for n, t in enumerate(templates)])
    return F.get(values, F.col("template"))


def summary(documents: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES) -> DataFrame:
    """Per document the places of the phrases, their labels, all labels, and the best share found."""
    found = scan(documents, [*phrases, *notices])
    names = F.array(*[F.lit(t.label) for t in [*phrases, *notices]])
    base = F.filter("spans", lambda s: s["template"] < len(phrases))

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.get(names, s["template"])))), ",")

    firsts = F.transform(base, lambda s: s["first"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.col("best").alias("score"),
    )
