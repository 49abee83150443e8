"""License scan by diagonal voting, in DataFrame operations only.

The hashes of all rolling two-word grams of every text join the places where the same pair stands in a template; the words
themselves verify each match.  A match votes for the diagonal (word place minus template place).  A span is a diagonal
with the ``drift`` next ones merged into it, so that inserted or lost words do not break it, yet it is never longer than
its template and the drift.  A template pair counts once in a span, on however many of its diagonals it stands.  A phrase
template counts only where all its pairs vote on one diagonal, which is where its words stand consecutively; a notice
template counts where a span covers at least ``coverage`` of its pairs.

Each text is read once: its number of words travels with a mark that every row carries into the join, so a text without
any match keeps its row.  The templates are a fixed table of a few hundred rows, the only data that is broadcast.

A null text counts as empty.  Rows that repeat a doc_id are told apart by their text; full repeats get the same result
each.  A null id is an id like others.  Empty tables give empty results; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases of the base columns and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Openings of public license notices, a license's bare name, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2", "apache-2"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("released under the mit license", "mit"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("mit license", "mit"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text):
    """The words of a text whose A-Z are lower-cased.  lower() is used where it cannot make an ASCII letter of another one: it does so only for U+0130 and U+212A."""
    body = F.coalesce(text, F.lit(""))
    low = F.when(body.rlike("[İK]"), F.translate(body, UPPER, UPPER.lower())).otherwise(F.lower(body))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


#: The template number of the mark that every text carries.
MARK = -1


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(h, a, b, tid, tpos, pairs, label, phrase): a row for each pair of each template, and one for the mark, whose words are empty."""
    rows = [f"('', '', {MARK}, 0, 1, '', false)"]
    for tid, (body, label, phrase) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        w = body.split()
        rows += [f"('{a}', '{b}', {tid}, {i}, {len(w) - 1}, '{label}', {str(phrase).lower()})" for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    values = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(a, b, tid, tpos, pairs, label, phrase)")
    return values.select(F.xxhash64("a", "b").alias("h"), "a", "b", "tid", "tpos", "pairs", "label", "phrase")


def votes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(_id, _key, tid, pairs, label, phrase, diagonal, places, n_words, copies): one row per text, template and diagonal with a vote; places are the template pairs that voted.

    Rows with tid MARK stand for the texts: n_words, and how many rows are alike in id and text.
    """
    listed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_key"), words(F.col(f"`{text}`")).alias("_w"))
    pair = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("b"))
    mark = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    rolled = listed.select("_id", "_key", F.size("_w").cast("long").alias("n_words"), F.posexplode(F.concat(mark, pair)).alias("_pos", "_p"))
    rolled = rolled.select("_id", "_key", "n_words", (F.col("_pos") - 1).alias("_pos"), F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b")).withColumn("h", F.xxhash64("_a", "_b"))
    # equality of the words, written so that the join's key stays the hash, a plain long
    same = " AND ".join(f"startswith(_{x}, {x}) AND startswith({x}, _{x})" for x in "ab")
    hit = rolled.join(F.broadcast(templates(docs.sparkSession, phrases, notices)), "h").where(same)
    diagonal = F.when(F.col("tid") == MARK, 0).otherwise(F.col("_pos") - F.col("tpos")).alias("diagonal")
    return hit.groupBy("_id", "_key", "tid", "pairs", "label", "phrase", diagonal).agg(F.collect_set("tpos").alias("places"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))


def _scored(v: DataFrame, drift: int) -> DataFrame:
    """votes with score: the share of the template's pairs that the span of a diagonal and those up to drift behind it covers; a phrase has its own diagonal only."""
    near = Window.partitionBy("_id", "_key", "tid").orderBy("diagonal").rangeBetween(0, drift)
    seen = F.when(F.col("phrase"), F.size("places")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))))
    return v.withColumn("score", seen / F.col("pairs"))


def _verified(v: DataFrame, coverage: float):
    return F.when(F.col("phrase"), F.col("score") == 1).otherwise(F.col("score") >= coverage) & (F.col("tid") != MARK)


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", coverage: float = 0.7, drift: int = 3, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(_id, _key, label, phrase, first, score): verified spans; first is the word at which the template would start on the span's first diagonal.  Of spans that overlap by their diagonals the best stays."""
    v = _scored(votes(docs, id_col, text, phrases, notices), drift)
    v = v.where(_verified(v, coverage))
    order = Window.partitionBy("_id", "_key", "tid").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > drift)
    v = v.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(order))
    best = F.max(F.struct(F.col("score"), -F.col("diagonal"))).alias("_best")
    return v.groupBy("_id", "_key", "tid", "label", "phrase", "_span").agg(best).select("_id", "_key", "label", "phrase", (-F.col("_best.col2")).alias("first"), F.col("_best.score").alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", coverage: float = 0.7, drift: int = 3, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest coverage of a verified span, 0 without)."""
    v = _scored(votes(docs, id_col, text, phrases, notices), drift)
    real = _verified(v, coverage)
    base = real & F.col("phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = v.groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("tid") == MARK, F.col("copies"))).alias("_copies"),
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(real, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("score"))), F.lit(0.0)).alias("score"),
    )
    each = found.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return each.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
