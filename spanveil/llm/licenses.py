"""License scan by diagonal voting, in DataFrame functions alone.

Every rolling k-gram of every text is joined, by hash and words, to the
positions where it stands in license templates. A copy of a template puts its
hits on one diagonal (position in the text minus position in the template); an
edit shifts the rest to a neighbouring one. Hits are counted by diagonal,
neighbouring diagonals merge, and a merged span is verified by how much of the
template it covers. An edit of more words puts the rest on a diagonal further
off; so hits of all diagonals that follow each other in text and template,
within the same stretch, are verified together as well.
"""

from __future__ import annotations

import string
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases of the base rule, and notices and headers by which licenses are known.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
# End of the fixed values.

#: Words are maximal runs of other characters than these, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for a null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, i + j) for j in range(k)))


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase's words in order."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + j) == p)
        return F.coalesce(out, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words)), here)


def template_positions(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(gram, template, label, at, grams): a row for each k-gram of each template, fixed by the templates given."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = text.split()
        rows += [(" ".join(w[i : i + k]), t, label, i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "gram string, template int, label string, at int, grams int")


def _longest_chain(hits: Column, grams: Column, repeats: int) -> Column:
    """The most hits, of (pos, at) sorted, that rise in both within a stretch of less than twice the grams."""

    def from_hit(first: Column, i: Column) -> Column:
        near = F.filter(F.slice(hits, i + 1, grams * (2 * repeats)), lambda h: h["pos"] - first["pos"] < grams * 2)

        def step(chains: Column, h: Column) -> Column:
            before = F.filter(chains, lambda c: (c["pos"] < h["pos"]) & (c["at"] < h["at"]))
            n = F.coalesce(F.array_max(F.transform(before, lambda c: c["n"])), F.lit(0)) + 1
            return F.concat(chains, F.array(F.struct(n.alias("n"), h["pos"].alias("pos"), h["at"].alias("at"))))

        chains = F.aggregate(near, F.array().cast("array<struct<n:int,pos:int,at:int>>"), step)
        return F.array_max(F.transform(chains, lambda c: c["n"]))

    return F.array_max(F.transform(hits, from_hit))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = 3, drift: int = 2, least: float = 0.75) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each document.

    Base: all places where a phrase's words stand in a row. The method adds the
    labels of templates of which a span, or a chain of hits over any diagonals,
    covers at least ``least`` of the k-grams; score is the greatest coverage of
    any template by one span, 0 without a hit. Diagonals not more than ``drift``
    apart merge to a span. Null and empty texts have no words and
    no labels. Rows that repeat a doc_id are told apart by their texts; rows that
    repeat both have equal results. Templates shorter than k words can't hit.
    Texts of any length are scanned whole; other columns, of any name, are not
    looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    told = docs.select("doc_id", F.xxhash64(text).alias("told"), words_of(text).alias("w"), F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("license")).alias("any"))
    none = F.array().cast("array<int>")
    base = told.select("doc_id", "told", F.size("w").cast("bigint").alias("n_words"), *(F.when(F.col("any"), _places(F.col("w"), p)).otherwise(none).alias(f"_{label}") for label, p in PHRASES))
    every = F.concat(*(F.col(f"_{label}") for label, _ in PHRASES))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"_{label}") > 0, F.lit(label)) for label, _ in PHRASES)))
    base = base.select("doc_id", "told", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), base_labels.alias("base_set"))

    # All rolling k-grams of all texts meet the templates' positions.
    rolled = told.where(F.size("w") >= k).select("doc_id", "told", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: _gram(F.col("w"), i, k))).alias("pos", "gram"))
    known = template_positions(spark, templates, k).withColumn("h", F.xxhash64("gram"))
    met = rolled.withColumn("h", F.xxhash64("gram")).join(F.broadcast(known), ["h", "gram"])  # as large as the templates
    hits = met.select("doc_id", "told", "template", "label", "grams", "pos", "at").distinct()
    # Votes by diagonal.
    key = ["doc_id", "told", "template", "label", "grams"]
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("start"), F.max("pos").alias("end"), F.collect_set("at").alias("ats"))
    # Neighbouring diagonals merge.
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(1))
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order)).groupBy(*key, "span").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.flatten(F.collect_list(F.transform("ats", lambda at: F.struct((at + F.col("diagonal")).alias("pos"), at.alias("at"))))).alias("hits"))
    # Verified: coverage, over a stretch of about the template's length.
    scored = merged.withColumn("score", F.col("covered") / F.col("grams")).withColumn("sound", (F.col("score") >= least) & (F.col("end") - F.col("start") < F.col("grams") * 2))
    # Chains over diagonals further apart, where the hits of all spans suffice and those of one don't.
    whole = scored.groupBy(*key).agg(F.max("score").alias("score"), F.max("sound").alias("sound"), F.sum("covered").alias("covered"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    repeats = max((n for _, text in templates for n in Counter(zip(*(text.split()[j:] for j in range(k)))).values()), default=1)
    open_ = ~F.col("sound") & (F.col("covered") >= F.col("grams") * least)
    whole = whole.withColumn("sound", F.when(open_, _longest_chain(F.col("hits"), F.col("grams"), repeats) >= F.col("grams") * least).otherwise(F.col("sound")))
    best = whole.groupBy("doc_id", "told").agg(F.max("score").alias("score"), F.collect_set(F.when(F.col("sound"), F.col("label"))).alias("more"))
    best = best.withColumnsRenamed({"doc_id": "_id", "told": "_told"})
    out = base.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("told").eqNullSafe(F.col("_told")), "left")
    labels = F.array_sort(F.array_union("base_set", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_set"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
