"""License scans by diagonal voting.

Every rolling word k-gram of every document is joined by its hash to the places of that k-gram in the
license templates. A hit votes for the diagonal (document place - template place); votes are added up
per document, template and diagonal, diagonals at most `drift` apart are merged, since a word left out
or added moves the rest of a copy to the next one, and a merged span is verified by the share of the
template's words that its hits cover in place. The templates are a fixed list, so their table is
broadcast: its size is known and does not grow with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veritally.llm import words as W
from veritally.llm.common import bounded_batches

# Phrases that name a license, and wordings of common notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)


def _base(phrases: dict[str, str]):
    wanted = [(W.one_hash(p, W.ALNUM), label) for p, label in phrases.items()]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                w = W.words(part["text"], W.ALNUM)
                text, first = w.text_of(), w.first()
                count = np.zeros(len(w.n), np.int64)
                least, most = np.full(len(w.n), np.iinfo(np.int64).max), np.full(len(w.n), -1)
                labels: list[set] = [set() for _ in w.n]
                for h, label in wanted:
                    last = len(w.h) - len(h) + 1
                    if last <= 0:
                        continue
                    at = np.flatnonzero(w.h[:last] == h[0])
                    for j in range(1, len(h)):
                        at = at[w.h[at + j] == h[j]]
                    at = at[text[at] == text[at + len(h) - 1]]
                    t, place = text[at], at - first[text[at]]
                    np.add.at(count, t, 1)
                    np.minimum.at(least, t, place)
                    np.maximum.at(most, t, place)
                    for i in np.unique(t):
                        labels[i].add(label)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(w.n), pa.array(count), pa.array(least, mask=count == 0), pa.array(most.astype(np.int64), mask=count == 0),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base"])

    return run


def _grams(k: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                w = W.words(part["text"], W.ALNUM)
                h, at = W.grams(w, k)
                text = w.text_of()[at]
                ids = W.ids_of(part["doc_id"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array((at - w.first()[text]).astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "at", "hash"])

    return run


def _templates(spark, templates, k: int) -> DataFrame:
    rows = []
    for i, (label, text) in enumerate(templates):
        w = W.words(pa.array([text]), W.ALNUM)
        h, at = W.grams(w, min(k, len(w.h)))
        rows += [(int(x), i, label, int(p), len(w.h)) for x, p in zip(h.view(np.int64), at, strict=True)]
    return spark.createDataFrame(rows, "hash long, template int, label string, place int, size int")


def license_labels(docs: DataFrame, k: int = 3, drift: int = 2, share: float = 0.8, templates=TEMPLATES, phrases=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named or quoted in each document.

    Words are runs of ASCII letters and digits (A-Z in lower case) and of characters beyond ASCII.
    Returns a row per row: doc_id, n_words, n_base (places of all phrases), first_word and last_word
    (smallest and largest start, null if none), base_labels and labels (sorted, comma-joined, empty
    if none; templates of fewer than 15 words must be there whole, longer ones to `share`), score (1 with a phrase, else the best verified share of a template, else 0) and spans
    (verified template copies). Templates of fewer than k words are not used. Null text: no words. Rows
    with one id share the labels found in any of them. Empty table: empty result. Extra columns are
    not read.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = docs.mapInArrow(_base(phrases or PHRASES), "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    templates = [t for t in templates if len(W.one_hash(t[1], W.ALNUM)) >= k]
    hits = docs.mapInArrow(_grams(k), "doc_id long, at int, hash long").join(F.broadcast(_templates(spark, templates, k)), "hash")
    hits = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    voted = hits.groupBy("doc_id", "template", "label", "size", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    ordered = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    voted = voted.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(ordered) <= drift, 0).otherwise(1))
    voted = voted.withColumn("span", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = voted.groupBy("doc_id", "template", "label", "size", "span").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.min("lo").alias("start"), (F.max("hi") + k).alias("stop"))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(k), F.coalesce(F.get("places", i + 1) - p, F.lit(k)))), F.lit(0), lambda acc, x: acc + x)
    # a word more or less makes another license of a short wording, so these must be there whole
    spans = spans.withColumn("share", covered / F.col("size")).where(F.col("share") >= F.when(F.col("size") < 15, 1.0).otherwise(share))
    found = spans.groupBy("doc_id").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("best"),
        F.sort_array(F.collect_list(F.struct("start", "stop", "label", "share"))).alias("spans"))
    out = base.withColumn("_key", F.coalesce("doc_id", F.lit(W.NO_ID))).join(found.withColumnRenamed("doc_id", "_key"), "_key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans")
