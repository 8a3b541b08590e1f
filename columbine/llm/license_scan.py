"""License scan by diagonal voting.

Words (ASCII letters, digits and non-ASCII characters after lower-casing A-Z)
are taken from the whole text and every rolling k-gram is hashed.  The hashes
are Spark-joined to the positions of the same k-grams in the templates (a
small broadcast of fixed size).  A hit at document word p and template word t
votes for the diagonal p - t.  Votes are added up per document, template and
diagonal; neighbouring diagonals (inserted or lost words shift it) are merged.
Diagonals are neighbours up to the shift that ``MIN_SIMILARITY`` lets a notice
of this size have.  In the merged hits, every span from one hit to another is
verified: the template words that its hits cover, taken against the longer of
template and span, must reach ``MIN_SIMILARITY``.  So repeated pieces of a
notice beside it do not take its label away.  Of verified spans that overlap,
the most similar one counts, the first of equal ones.

Base phrases are templates too (k = ``PHRASE_GRAM``); they count only where
every k-gram of the phrase votes for one diagonal, that is, where the words
stand consecutively.  Notices have k = ``NOTICE_GRAM``.

Each document sends one marker row through the same join, so documents
without a hit come out as well and the text is read once; only hits and
markers are shuffled.

Defined cases: null and empty texts have no words and no label; rows that
agree in id and text are counted and given back each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columbine.llm.common import materialize

PHRASE_GRAM = 2
NOTICE_GRAM = 5
MAX_SHIFT = 4  # diagonals this near are merged for short notices too
MIN_SIMILARITY = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening or grant passages of public license notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
            "was not distributed with this file"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Words of the longest span in which any notice reaches MIN_SIMILARITY.
MAX_REACH = max(int(len(text.split()) / MIN_SIMILARITY) for _, text in NOTICES)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _grams(w: Column, k: int) -> Column:
    """(k, position, hash) of every rolling k-gram of a word array."""
    last = F.size(w) - k
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)]).alias("h")),
    )).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def templates(spark) -> DataFrame:
    """(template, label, k, size, base, tpos, h) of all template k-grams."""
    rows = [(i, label, PHRASE_GRAM, text, True) for i, (text, label) in enumerate(PHRASES.items())]
    rows += [(100 + i, label, NOTICE_GRAM, text, False) for i, (label, text) in enumerate(NOTICES)]
    t = spark.createDataFrame(rows, "template int, label string, k int, text string, base boolean") \
        .withColumn("w", F.split("text", " "))
    parts = [t.where(F.col("k") == k).select(
        "template", "label", "k", F.size("w").alias("size"), "base", F.inline(_grams(F.col("w"), k)))
        for k in (PHRASE_GRAM, NOTICE_GRAM)]
    return parts[0].union(parts[1]).withColumnRenamed("pos", "tpos")


def hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Template hits and one marker (template null) per row of ``docs``."""
    w = docs.select(id_col, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_th"), words(F.col(text_col)).alias("_w"))
    marker = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("h")))
    rows = w.select(id_col, "_th", F.size("_w").cast("bigint").alias("n_words"), F.inline(
        F.concat(marker, _grams(F.col("_w"), PHRASE_GRAM), _grams(F.col("_w"), NOTICE_GRAM))))
    t = F.broadcast(templates(docs.sparkSession))  # fixed size: a few hundred rows
    return rows.join(t, "h", "left").where("template is not null or pos = -1").drop("h")


def spans(found: DataFrame, id_col: str) -> DataFrame:
    """Verified spans (id_col, _th, template, label, base, first, last, similarity)."""
    key = [id_col, "_th", "template"]
    votes = found.where("template is not null") \
        .withColumn("diagonal", F.col("pos") - F.col("tpos")) \
        .groupBy(*key, "label", "k", "size", "base", "diagonal") \
        .agg(F.collect_set("pos").alias("at"))  # at most the template's length
    phrase = votes.where("base").where(F.size("at") == F.col("size") - F.col("k") + 1).select(
        *key, "label", "base", F.col("diagonal").alias("first"),
        (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("similarity"))
    # neighbouring diagonals of one template: a new group starts after a gap
    w = Window.partitionBy(*key).orderBy("diagonal")
    reach = F.floor(F.col("size") / MIN_SIMILARITY).cast("int")  # longest span that can be similar enough
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.greatest(F.lit(MAX_SHIFT), reach - F.col("size")),
                     F.lit(True))
    key = [*key, "group"]
    notice = votes.where("not base").withColumn("group", F.sum(gap.cast("int")).over(w)) \
        .select(*key, "label", "base", "size", reach.alias("reach"), "diagonal", F.explode("at").alias("first")) \
        .withColumn("hit", F.struct("first", (F.col("first") - F.col("diagonal")).alias("tpos")))
    # the hits that a span from this one on may have: at most a few times MAX_REACH
    ahead = Window.partitionBy(*key).orderBy("first").rangeBetween(0, MAX_REACH - NOTICE_GRAM)
    notice = notice.withColumn("hits", F.collect_list("hit").over(ahead)).where(F.array_min("hits") == F.col("hit"))

    def span(length: Column) -> Column:
        """(similarity, end: minus the last word) of the hits within ``length`` words."""
        within = F.filter("hits", lambda h: h["first"] + NOTICE_GRAM <= F.col("first") + length)
        covered = F.size(F.array_distinct(F.flatten(F.transform(
            within, lambda h: F.sequence(h["tpos"], h["tpos"] + F.lit(NOTICE_GRAM - 1))))))
        last = F.array_max(F.transform(within, lambda h: h["first"])) + NOTICE_GRAM - 1
        return F.struct((covered / F.greatest(F.col("size"), last - F.col("first") + 1)).alias("similarity"),
                        (-last).alias("end"))

    most = F.size(F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["tpos"], h["tpos"] + F.lit(NOTICE_GRAM - 1))))))
    notice = notice.where(most / F.col("size") >= MIN_SIMILARITY) \
        .withColumn("best", F.array_max(F.transform(F.sequence("size", "reach"), span))) \
        .select(*key, "label", "base", "first", (-F.col("best.end")).alias("last"), "best.similarity") \
        .where(F.col("similarity") >= MIN_SIMILARITY)
    near = Window.partitionBy(*key).orderBy("first").rangeBetween(1 - MAX_REACH, MAX_REACH - 1)
    better = F.exists("rivals", lambda r: (r["first"] <= F.col("last")) & (r["last"] >= F.col("first")) & (
        (r["similarity"] > F.col("similarity"))
        | (r["similarity"] == F.col("similarity")) & (r["first"] < F.col("first"))))
    notice = notice.withColumn("rivals", F.collect_list(F.struct("first", "last", "similarity")).over(near)) \
        .where(~better).drop("rivals", "group")
    return phrase.unionByName(notice)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans) for every row of ``docs``; score is the best similarity."""
    found = materialize(hits(docs, id_col, text_col), "license-hits")
    verified = spans(found, id_col).groupBy(id_col, "_th").agg(
        F.sum(F.col("base").cast("bigint")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_set"),
        F.collect_set("label").alias("set"), F.max("similarity").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "similarity"))).alias("spans"))
    rows = found.where("pos = -1").select(id_col, "_th", "n_words")
    verified = verified.withColumnsRenamed({id_col: "_vid", "_th": "_vth"})
    out = rows.join(verified, F.col(id_col).eqNullSafe(F.col("_vid")) & (F.col("_th") == F.col("_vth")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.array_join(F.sort_array(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.coalesce("set", none)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
