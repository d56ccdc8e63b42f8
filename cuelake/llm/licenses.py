"""License scans by diagonal voting, in DataFrame functions only.

Every rolling two-word gram of a text is joined by hash to its positions in a fixed set of license
templates. Hits of one template on one offset (text position less template position) are a diagonal;
neighbouring diagonals, which a missing or added word makes, are merged, and a merged span counts if
it covers enough of its template in little more room than the template takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase and label; every place of a phrase counts.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Texts whose spans the method finds, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
)


@dataclass(frozen=True)
class LicenseScan:
    """drift: offsets that still are neighbours. cover: least share of a template's grams.

    room: the longest span, in template lengths.
    """

    drift: int = 3
    cover: float = 0.75
    room: float = 1.5


def _templates(spark: SparkSession) -> DataFrame:
    """gram, template, at, base, label, grams: a few hundred rows, whatever the input."""
    rows = [(phrase, label, True) for phrase, label in BASE] + [(t, label, False) for t, label in TEMPLATES]
    listed = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(base).alias("base")) for t, label, base in rows))
    d = spark.range(1).select(F.posexplode(listed).alias("template", "r"))
    d = d.select("template", "r.label", "r.base", F.split("r.t", " ").alias("w"))
    d = d.select("template", "label", "base", (F.size("w") - 1).alias("grams"), F.posexplode(F.slice("w", 1, F.size("w") - 1)).alias("at", "x"), "w")
    return d.select(F.xxhash64("x", F.get("w", F.col("at") + 1)).alias("gram"), "template", "label", "base", "grams", "at")


def license_spans(docs: DataFrame, p: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, n_words, and spans found: template, label, base, first and last word, cover.

    A text without a hit has one row with a null template. Rows with one doc_id and text are one here;
    ``copies`` of the row with the null template tells how many they are.
    """
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, SPLIT), lambda w: w != "")
    d = docs.select("doc_id", F.xxhash64("text").alias("k"), words.alias("w"))
    grams = F.transform("w", lambda w, i: F.xxhash64(w, F.get(F.col("w"), i + 1)))
    # the first element stands for the text itself, so that one pass keeps texts without a hit
    d = d.select("doc_id", "k", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit(0).cast("long")), grams).alias("g"))
    # outer, else a filter on the array's size is inferred that works all grams out once for each word
    d = d.select("doc_id", "k", "n_words", F.posexplode_outer("g").alias("pos", "gram"))
    spark = docs.sparkSession
    itself = spark.range(1).select(F.lit(0).cast("long").alias("gram"), F.lit(None).cast("int").alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("grams"), F.lit(0).alias("at"))
    hit = d.join(F.broadcast(_templates(spark).unionByName(itself)), "gram").where("template is not null or pos = 0")
    hit = hit.where("template is null or pos > 0").withColumn("offset", F.col("pos") - 1 - F.col("at"))
    doc = ["doc_id", "k", "n_words"]
    diagonal = hit.groupBy(*doc, "template", "label", "base", "grams", "offset").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("rows"))
    # a base phrase needs its one diagonal whole; others merge with neighbours
    diagonal = diagonal.where(~F.col("base") | (F.size("ats") == F.col("grams")))
    line = Window.partitionBy(*doc, "template").orderBy("offset")
    fresh = F.col("base") | F.coalesce(F.col("offset") - F.lag("offset").over(line) > p.drift, F.lit(True))
    merged = diagonal.withColumn("island", F.sum(fresh.cast("int")).over(line)).groupBy(*doc, "template", "label", "base", "grams", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), (F.min("lo") - 1).alias("first"), F.max("hi").alias("last"), F.sum("rows").alias("rows")
    )
    cover = F.col("n") / F.greatest(F.col("grams"), F.lit(1))
    fits = F.col("base") | ((cover >= p.cover) & (F.col("last") - F.col("first") + 1 <= p.room * (F.col("grams") + 1)))
    return merged.select(*doc, "template", "label", "base", F.col("first").cast("long"), F.col("last").cast("long"), F.when(F.col("template").isNotNull(), cover).alias("cover"), (fits & F.col("template").isNotNull()).alias("found"), F.when(F.col("template").isNull(), F.col("rows")).alias("copies"))


def license_report(docs: DataFrame, p: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text.

    Labels are distinct, sorted, joined by commas; an empty string where there are none. The score
    is the best share of a template that a found span covers. Null and empty texts have no words and
    score 0. Rows that repeat a doc_id and its text give one row each. Other columns are not read.
    """
    spans = license_spans(docs, p)
    base, found = F.col("base") & F.col("found"), F.col("found")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    report = spans.groupBy("doc_id", "k", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    # a row for each copy, by thousands, so that no array is long
    thousand = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 1000")))
    report = report.withColumn("part", thousand).withColumn("left", F.least(F.lit(1000).cast("long"), F.col("copies") - 1000 * F.col("part")))
    return report.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left")))).drop("k", "copies", "part", "left", "nth")
