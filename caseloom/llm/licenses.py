"""License scans: a positional index of licence templates' rare words, looked up and intersected; key phrases verified. DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed values: (label, notice or passage, mandatory key phrases), from the public texts of common licences.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("gnu general public license", "free software foundation")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache", "licensed under the apache license version", ("apache license version",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("without warranties or conditions of any kind",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
    ("cc-by", "licensed under cc by", ("cc by",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain", ("neighboring rights", "public domain")),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)
#: The least share of a template's weight that must meet at one relative position.
LEAST = 0.6


def idf(templates: tuple = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of the words over the templates."""
    df = Counter(w for _, text, _ in templates for w in set(text.split()))
    return {w: round(math.log(1 + len(templates) / n), 6) for w, n in df.items()}


def postings(templates: tuple = TEMPLATES, rarest: int = 6) -> dict[str, list[tuple[int, int]]]:
    """word: [(template, position)] for the rarest words of each template; words that most templates share are not indexed."""
    weight, out = idf(templates), {}
    for t, (_, text, _) in enumerate(templates):
        words = text.split()
        best = sorted(set(words), key=lambda w: (-weight[w], w))[:rarest]
        for i, w in enumerate(words):
            if w in best:
                out.setdefault(w, []).append((t, i))
    return out


def normal(text: Column) -> Column:
    """The words of a text (A-Z in lower case; runs of 0-9, a-z and characters beyond ASCII) with single spaces between and around them."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _AZ, _az)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _places(phrase: str) -> Column:
    """Where the phrase's words start in the array `words`; docs without the phrase are not walked."""
    own = phrase.split()
    test = " and ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(own))
    walk = f"filter(sequence(0, size(words) - {len(own)}), i -> {test})"
    return F.expr(f"case when contains(norm, ' {phrase} ') then {walk} else cast(array() as array<int>) end")


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, base: dict[str, str] = BASE, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) per row of docs(doc_id, text).

    Base labels come from phrases whose words stand consecutively. The index adds labels: all of a file's licence words
    are looked up in the templates' postings; file position less template position must agree for words of at least the
    share `least` of a template's indexed weight, and all the template's key phrases must stand in the file. score is
    the best share of a verified template, or at least 0.9 with a base phrase, else 0; matches are (label, share, first
    word) of the verified templates. A null text is empty; repeated rows give equal rows; extra columns are not read; an
    empty table gives an empty result.

    The text is read in one pass each for words and lookups and never shuffled: only licence words leave their task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), normal(F.col("text")).alias("norm"))
    words = F.when(F.col("norm") == " ", F.array().cast("array<string>")).otherwise(F.split(F.trim("norm"), " "))
    keyed = keyed.withColumn("words", words)
    phrases = sorted({p for _, _, own in templates for p in own})
    held = F.expr(f"filter(array({', '.join(f"'{p}'" for p in phrases)}), p -> contains(norm, concat(' ', p, ' ')))")
    each = [_places(p).alias(f"p{i}") for i, p in enumerate(base)]
    scanned = keyed.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), held.alias("held"), *each)
    starts = F.concat(*(F.col(f"p{i}") for i in range(len(base))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, v) for i, v in enumerate(base.values()))))
    scanned = scanned.select("doc_id", "key", "n_words", "held", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))

    weight, index = idf(templates), postings(templates)
    total = [sum(weight[w] for w, at in index.items() for t, _ in at if t == n) for n in range(len(templates))]
    known = spark.createDataFrame([(w, weight[w], at) for w, at in sorted(index.items())], "word string, idf double, at array<struct<t: int, i: int>>")
    hits = keyed.select("doc_id", "key", F.posexplode("words").alias("place", "word")).join(F.broadcast(known.select("word", "idf")), "word")
    by_word = hits.groupBy("doc_id", "key", "word", "idf").agg(F.collect_set("place").alias("places"))
    # Gathered by file and in the words' order: all that follows stays in the file's task, and sums are alike in every run.
    held_words = by_word.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("word", "idf", "places"))).alias("ws"))
    looked = held_words.select("doc_id", "key", F.explode("ws").alias("w")).select("doc_id", "key", "w.*")
    met = looked.join(F.broadcast(known.select("word", "at")), "word").select("doc_id", "key", "idf", "places", F.explode("at").alias("a"))
    met = met.select("doc_id", "key", "idf", F.col("a.t").alias("t"), F.explode(F.expr("transform(places, p -> p - a.i)")).alias("start"))
    table = spark.createDataFrame([(n, label, total[n], list(own)) for n, (label, _, own) in enumerate(templates)], "t int, label string, total double, needs array<string>")
    shares = met.groupBy("doc_id", "key", "t", "start").agg(F.sum("idf").alias("sum")).join(F.broadcast(table), "t").withColumn("share", F.least(F.lit(1.0), F.round(F.col("sum") / F.col("total"), 4))).where(F.col("share") >= least)
    best = shares.groupBy("doc_id", "key", "label", "needs").agg(F.max_by(F.struct("share", "start"), F.struct("share", -F.col("start"))).alias("best"))
    found = best.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("label", F.col("best.share").alias("share"), F.col("best.start").alias("start"), "needs"))).alias("found"))

    joined = scanned.alias("s").join(found.alias("f"), F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.key") == F.col("f.key")), "left").select("s.*", F.coalesce("found", F.array()).alias("found"))
    verified = F.expr("transform(filter(found, m -> size(array_except(m.needs, held)) = 0), m -> struct(m.label as label, m.share as share, m.start as start))")
    out = joined.withColumn("matches", verified)
    every = F.array_sort(F.array_distinct(F.concat("base", F.expr("transform(matches, m -> m.label)"))))
    share = F.coalesce(F.array_max(F.expr("transform(matches, m -> m.share)")), F.lit(0.0))
    score = F.greatest(share, F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "matches")
