"""License scans: a positional index of rare licence words, built from DataFrame functions alone.

Texts are lower-cased (A-Z) and split into words of letters, digits and non-ASCII characters. The templates are short
licence notices; their words are indexed with positions and an IDF over the templates. A document keeps only the words
that the index knows, with their places. Its highest-IDF words are looked up; the template postings they hit are
intersected by relative position (place in the document minus place in the template), and an alignment's score is the
IDF-weighted part of the template that stands at it. A template is found when the score reaches MIN_SCORE and one of
its mandatory key phrases stands in the document. Short base phrases are places where their words stand consecutively.

The index has a row per template word: some hundreds, fixed by TEMPLATES, so it is broadcast at any size of the table.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows are scanned
each; null doc_ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed

#: Phrase and label of the base places.
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label, notice, mandatory key phrases (one of them has to stand in the text).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0", "apache license version 2"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]
MIN_SCORE = 0.8
#: Words of a template that are looked up first: those of the highest IDF.
RARE_WORDS = 4
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def index() -> list[tuple[str, int, int, float, bool]]:
    """word, template, position, its share of the template's IDF, and whether it is one of the rare words."""
    words = [text.split() for _, text, _ in TEMPLATES]
    found = {w: sum(w in own for own in words) for own in words for w in own}
    idf = {w: math.log(1 + len(words) / n) for w, n in found.items()}
    rows = []
    for t, own in enumerate(words):
        total = sum(idf[w] for w in own)
        rare = set(sorted(range(len(own)), key=lambda p, own=own: (-idf[own[p]], p))[:RARE_WORDS])
        rows += [(w, t, p, idf[w] / total, p in rare) for p, w in enumerate(own)]
    return rows


def lowered(text: Column) -> Column:
    """A-Z lower-cased: the only other characters whose lower case has ASCII letters are masked before."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "İK", "ǂǂ"))


def _places(words: Column, phrase: str) -> Column:
    """Places, from 0, where the phrase's words stand consecutively."""
    first, *rest = phrase.split()
    spots = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    follow = lambda i: [F.get(words, i + k) == w for k, w in enumerate(rest, 1)]

    def all_follow(i: Column) -> Column:
        out = F.lit(True)
        for x in follow(i):
            out = out & F.coalesce(x, F.lit(False))
        return out

    return F.filter(spots, all_follow)


def scanned(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is the best alignment's, or 1 for a base phrase.
    """
    spark = documents.sparkSession
    rows = index()
    vocabulary = sorted({w for w, *_ in rows})
    # Each base phrase and each mandatory key phrase has one of these words; of texts without them, words are only counted.
    needed = sorted({max(p.split(), key=lambda w: (len(w), w)) for p in [p for p, _ in BASE_PHRASES] + [p for _, _, own in TEMPLATES for p in own]})
    text = lowered(F.col("text").cast("string"))
    base = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    split = base.select("row", "doc_id", F.split("text", _BREAKS).alias("split"), F.col("text").rlike("|".join(map(re.escape, needed))).alias("maybe"))
    inner = F.size("split") - F.when(F.element_at("split", 1) == "", 1).otherwise(0) - F.when((F.size("split") > 1) & (F.element_at("split", -1) == ""), 1).otherwise(0)
    words = F.when(F.col("maybe"), F.filter("split", lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    worded = split.select("row", "doc_id", inner.cast("long").alias("n_words"), words.alias("words"))

    labelled = worded.select("*", *(_places(F.col("words"), p).alias(f"base_{k}") for k, (p, _) in enumerate(BASE_PHRASES)))
    all_places = F.concat(*(F.col(f"base_{k}") for k in range(len(BASE_PHRASES))))
    flags = F.array(*(F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE_PHRASES)))
    known = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda x: x["word"].isin(vocabulary))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    keyed = F.array(*(F.when(_any(joined, phrases), F.lit(t)) for t, (_, _, phrases) in enumerate(TEMPLATES)))
    scanned_words = checkpointed(labelled.select(
        "row", "doc_id", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.filter(flags, lambda x: x.isNotNull()))).alias("base"), known.alias("known"), F.filter(keyed, lambda x: x.isNotNull()).alias("keyed"),
    ))
    postings = F.broadcast(_values(spark, rows, "word, template, position, weight, rare"))
    hits = (
        scanned_words.filter(F.size("keyed") > 0).select("row", "keyed", F.explode("known").alias("x")).select("row", "keyed", "x.word", "x.place")
        .join(postings, "word").filter(F.array_contains("keyed", F.col("template")))
        .groupBy("row", "template", (F.col("place") - F.col("position")).alias("shift"))
        .agg(F.sum("weight").alias("score"), F.count_if("rare").alias("rare"))
        .filter((F.col("rare") > 0) & (F.col("score") >= min_score))
    )
    names = F.broadcast(_values(spark, [(t, label) for t, (label, _, _) in enumerate(TEMPLATES)], "template, label"))
    found = hits.join(names, "template").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = scanned_words.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.round(F.coalesce("best", F.lit(0.0)), 6)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A constant table."""
    literal = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({names})")


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(f" {p} ")
    return out


def oracle_sql(min_score: float = MIN_SCORE) -> str:
    """The same scan in DuckDB's SQL, for tables with one row per doc_id."""
    quoted = ", ".join(f"('{w}', {t}, {p}, {x!r}::DOUBLE, {str(r).lower()})" for w, t, p, x, r in index())
    names = ", ".join(f"({t}, '{label}')" for t, (label, _, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({t}, '{p}')" for t, (_, _, own) in enumerate(TEMPLATES) for p in own)
    base = " UNION ALL ".join("SELECT doc_id, place, '{1}' AS label FROM n WHERE {0}".format(" AND ".join(f"w{k} = '{w}'" for k, w in enumerate(p.split())), label) for p, label in BASE_PHRASES)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(translate(coalesce(text, ''), 'İK', 'ǂǂ')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM w),
n AS (SELECT doc_id, place, word AS w0, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
b AS ({base}),
c AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM b GROUP BY doc_id),
k AS (SELECT DISTINCT doc_id, template FROM w, (VALUES {phrases}) AS v(template, phrase) WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')),
i AS (SELECT * FROM (VALUES {quoted}) AS v(word, template, position, weight, rare)),
h AS (SELECT u.doc_id, i.template, sum(weight) AS score FROM u JOIN i USING (word) JOIN k ON k.doc_id = u.doc_id AND k.template = i.template GROUP BY u.doc_id, i.template, place - position HAVING sum(weight) >= {min_score} AND bool_or(rare)),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(score) AS best FROM h JOIN (VALUES {names}) AS v(template, label) USING (template) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, round(coalesce(best, 0), 6)) END AS score
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""
