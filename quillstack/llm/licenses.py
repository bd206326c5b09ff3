"""License scans by diagonal voting, with DataFrame functions only.

All rolling word k-gram hashes of the texts are joined to the positions where license templates have them, and a hit
counts only if its words are the template's. The difference of the two positions is the diagonal an undisturbed copy
would lie on. Hits are gathered by diagonal. A base phrase stands where one diagonal holds all of its k-grams. For
the longer templates neighbouring diagonals (insertions, deletions) are merged in overlapping bands of bounded width,
so that two diagonals up to half a band apart share one, and a chain of merges can't grow. A band is verified by the
longest sequence of its hits that goes forward in text and template at once: each template place counts once, in
order, so that repeats of one k-gram add nothing. The share of the template's k-grams in it is the coverage.

The template table has a few hundred rows fixed in this module, which is why it may be broadcast.

Defined results: null text is empty; a text without words has counts of 0, null positions, empty labels and score
0; rows that repeat id and text are scanned once and returned as often as they came; an empty table gives no rows; further
columns are not read, whatever their names. score is the best coverage of any template, 1 for a base phrase.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

K = 3
#: A span must cover this share of its template's k-grams, in order.
COVER = 0.6
#: A span may be this many times as long as its template, which gives the width of its bands.
STRETCH = 2.0

# Phrases that label a text wherever they stand.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Openings of public license notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Position and hash of the row that stands for the document itself.
_OWN = -1


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: letters, digits and everything beyond ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def template_grams(spark, base=None, templates=None) -> DataFrame:
    """(h, gram, kind, label, tpos, grams): where each template has each k-gram, of how many."""
    rows = []
    for kind, table in (("base", base or BASE), ("full", templates or TEMPLATES)):
        for label, text in table.items():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            rows += [(" ".join(w[p : p + K]), kind, label, p, len(w) - K + 1) for p in range(len(w) - K + 1)]
    t = spark.createDataFrame(rows, "tgram string, kind string, label string, tpos int, grams int")
    return t.withColumn("h", F.xxhash64("tgram"))


def _grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, n_words, pos, h, gram): all rolling k-grams, and one row at position -1 for the document."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    # A document is known by its id and 128 bits of its text, so that a task that runs again names it alike.
    w = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), words(text).alias("w"))
    n = F.size("w")
    one = lambda pos, gram: F.struct(pos.cast("int").alias("pos"), gram.alias("gram"))
    grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: one(i, F.concat_ws(" ", *[F.get("w", i + j) for j in range(K)])))
    own = F.array(one(F.lit(_OWN), F.lit("")))
    rows = w.select("doc_id", "t1", "t2", n.cast("long").alias("n_words"), F.explode(F.when(n >= K, F.concat(own, grams)).otherwise(own)).alias("g"))
    return rows.select("doc_id", "t1", "t2", "n_words", "g.pos", "g.gram", F.xxhash64("g.gram").alias("h"))


def _longest_forward(points: Column, grams: Column) -> Column:
    """How many of points(pos, tpos), sorted by pos and falling tpos, can follow each other upwards in both."""

    def add(best: Column, x: Column) -> Column:
        # best[t]: the longest sequence so far that ends at template place t.
        before = F.coalesce(F.array_max(F.slice(best, 1, x["tpos"])), F.lit(0))
        return F.transform(best, lambda v, i: F.when(i == x["tpos"], F.greatest(v, before + 1)).otherwise(v))

    return F.array_max(F.aggregate(points, F.array_repeat(F.lit(0), grams), add))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=None, templates=None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row."""
    spark, doc = docs.sparkSession, ["doc_id", "t1", "t2"]
    is_ = lambda kind: F.col("kind") == kind
    t = template_grams(spark, base, templates)
    t = t.union(spark.createDataFrame([("", "own", "", 0, 0)], "tgram string, kind string, label string, tpos int, grams int").withColumn("h", F.xxhash64("tgram")))
    hits = _grams(docs, id_col, text_col).join(F.broadcast(t), "h").filter(F.col("gram") == F.col("tgram"))
    # Each row of a document that came more than once has the same hits: places are sets, the own row counts.
    votes = hits.groupBy(*doc, "kind", "label", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.max("n_words").alias("n_words"), F.max("grams").alias("grams"), F.collect_set("tpos").alias("places"), F.count("*").alias("seen"))
    # Bands are as wide as the template allows; each diagonal lies in two, which overlap by half. Base phrases keep their diagonals.
    width = F.greatest(F.lit(2), F.floor(F.col("grams") * (STRETCH - 1)).cast("int"))
    band = lambda k: F.struct(F.lit(k).alias("shift"), F.floor((F.col("diag") + k * F.floor(width / 2)) / width).alias("band"))
    bands = F.when(is_("full"), F.array(band(0), band(1))).otherwise(F.array(F.struct(F.lit(0).alias("shift"), F.col("diag").cast("long").alias("band"))))
    points = F.transform("places", lambda p: F.struct((F.col("diag") + p).alias("pos"), (-p).alias("back")))
    merged = votes.select(*doc, "kind", "label", "n_words", "grams", "seen", points.alias("points"), F.explode(bands).alias("at"))
    merged = merged.groupBy(*doc, "kind", "label", "at").agg(F.max("n_words").alias("n_words"), F.max("grams").alias("grams"), F.sum("seen").alias("seen"), F.flatten(F.collect_list("points")).alias("points"))
    forward = _longest_forward(F.transform(F.array_sort("points"), lambda x: F.struct(x["pos"].alias("pos"), (-x["back"]).alias("tpos"))), F.col("grams"))
    spans = merged.select(*doc, "kind", "label", "n_words", "seen", F.col("at.band").alias("at"), F.when(is_("own"), 0.0).when(is_("base"), (F.size("points") == F.col("grams")).cast("double")).otherwise(forward / F.col("grams")).alias("cover"))
    whole, full = is_("base") & (F.col("cover") == 1), is_("full") & (F.col("cover") >= COVER)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"), F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("at"))).alias("first_word"), F.max(F.when(whole, F.col("at"))).alias("last_word"),
        joined(whole).alias("base_labels"), joined(whole | full).alias("labels"), F.max(F.when(whole | is_("full"), F.col("cover")).otherwise(0.0)).alias("score"), F.sum(F.when(is_("own"), F.col("seen"))).alias("rows"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("t1", "t2", "rows", "copy")
