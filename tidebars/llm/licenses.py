"""License scans by diagonal voting, with DataFrame functions only.

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. All rolling word k-grams meet the k-grams
of the templates in a join on their hash (and, against collisions, on their words). Each meeting votes for a diagonal, the
gram's place in the text less its place in the template: a copy of a template votes on one diagonal, a copy with words put
in or left out on neighbouring ones. Votes are counted for each diagonal before they are shuffled, neighbouring diagonals
are merged into spans, and a span is verified by the share of the template's grams that it holds. A base phrase is found
where one diagonal has all of its grams, which is where its words stand consecutively.

The templates are a fixed list of this module, a few hundred grams: what is broadcast does not grow with the data.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a gram.
K = 3
#: The phrases whose every place is reported, with their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Further wordings by which licenses are named or granted.
TEMPLATES = [
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """The words of a text; none of a null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_rows() -> list[tuple[str, int, str, bool, int, int]]:
    """(gram, template, label, base, grams, at): the grams of all templates, and one row for the mark of each document."""
    rows = [("", -1, "", False, 1, 0)]
    for t, (base, (label, text)) in enumerate([(True, x) for x in BASE] + [(False, x) for x in TEMPLATES]):
        w = text.split()
        rows += [(" ".join(w[i : i + K]), t, label, base, len(w) - K + 1, i) for i in range(len(w) - K + 1)]
    return rows


def template_grams(df: DataFrame) -> DataFrame:
    """The rows of ``gram_rows`` with their hash h."""
    got = df.sparkSession.createDataFrame(gram_rows(), "gram string, template int, label string, base boolean, grams int, at int")
    return got.withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, least: float = 0.8, apart: int = 2) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row.

    ``least``: the share of a template's grams that a span must hold; ``apart``: how far merged diagonals may be from each
    other. score is the largest share among accepted spans (0 if none); spans holds (label, start, end, share). Null and
    empty texts have no words and no labels; repeated rows and rows without doc_id are reported like others; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w"))
    w = F.col("w")
    grams = F.transform(w, lambda x, i: F.when(i + (K - 1) < F.size(w), F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, K)))))
    # The words themselves stay behind: only their number goes along with each gram.
    rows = rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), grams).alias("g"))
    placed = rows.select("rid", "doc_id", "n_words", F.posexplode("g").alias("pos", "gram"))
    met = placed.withColumn("h", F.xxhash64("gram")).join(F.broadcast(template_grams(docs)), ["h", "gram"])
    # The empty gram is each document's mark: it keeps documents without any vote.
    diagonal = met.withColumn("diagonal", F.when(F.col("template") < 0, 0).otherwise(F.col("pos") - 1 - F.col("at")))
    key = ["rid", "doc_id", "n_words", "template", "label", "base", "grams"]
    votes = diagonal.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = W.partitionBy("rid", "template").orderBy("diagonal")
    new = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) <= apart), 0).otherwise(1)
    votes = votes.withColumn("new", F.when(F.col("base"), 1).otherwise(new))
    votes = votes.withColumn("cluster", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    span = votes.groupBy(*key, "cluster").agg(
        F.sum("votes").alias("votes"), (F.min("lo") - 1).cast("long").alias("start"), (F.max("hi") - 1 + K).cast("long").alias("end")
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    good = F.when(F.col("template") < 0, False).when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(share >= least)
    span = span.withColumn("share", share).withColumn("good", good).withColumn("hit", F.col("good") & F.col("base"))
    joined = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    out = span.groupBy("rid", "doc_id", "n_words").agg(
        F.count(F.when(F.col("hit"), 1)).alias("n_base"),
        F.min(F.when(F.col("hit"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("hit"), F.col("start"))).alias("last_word"),
        joined(F.col("hit")).alias("base_labels"),
        joined(F.col("good")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("start", "end", "label", "share")))).alias("spans"),
    )
    return out.drop("rid")
