"""License scans: exact phrases, and a set-similarity join with templates.

Phrases are found where their words stand one after another (``scan_phrases``).
Templates are license notices taken as sets of words. A document has a
template's license if some ``SPREAD`` times as many words in a row as the notice
has, whatever lines they stand on, hold at least ``CONTAINED`` of its words, and
among these the ones that set it apart, but none that names a sibling (``MARKS``;
a window ends at such a word). The join is exact over all such windows. Template words are put in one global order,
rarest in the corpus first (counted over all documents). A template of n words
that must share o of them has a prefix of its n - o + 1 rarest; a window without
any of these can't reach o. Each place of a prefix word is met with its
templates by an equi-join; what can't reach o with all words within reach of the
place is dropped, and every window around the rest is verified by intersection.

DataFrame functions only. What is broadcast is made from the templates, and
only up to ``MAX_BROADCAST`` rows; documents are not shuffled, only one slim row
each.

Defined results for odd input: a null or empty text has no words, no places,
empty label strings and score 0; rows of equal id and text give equal results,
each; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.llm.workers import quoted
from winnow_spark.session import cut_lineage, read_table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINED = 0.9
#: Room in a window for words that a notice has besides the template's, such as comment marks before its lines.
SPREAD = 1.25

# Phrases and notices of public licenses, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: By label: words a window must hold, and words of sibling licenses that it must not.
MARKS = {
    "gpl": (("gnu",), ("lesser", "affero")),
    "lgpl": (("lesser",), ("affero",)),
    "agpl": (("affero",), ("lesser",)),
    "apache": (("apache",), ()),
    "mpl": (("mozilla",), ()),
    "cc-by": (("attribution",), ("sharealike", "noncommercial", "commercial", "noderivatives", "noderivs", "derivatives", "derivs", "nc", "nd", "sa")),
    "cc-by-nc": (("nc",), ("nd", "sa")),
    "cc-by-sa": (("sharealike",), ("noncommercial", "commercial", "nc")),
    "unlicense": (("unencumbered",), ()),
}
#: Other names of marks: the Lesser license's former one, and a spelling.
SPELLINGS = (("library", "general", "lesser general"), ("share", "alike", "sharealike"))


#: Rows made from templates that are broadcast at most (some hundred bytes each); more are joined by a shuffle.
MAX_BROADCAST = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _lower(text: Column) -> Column:
    # Beyond A-Z this lowers letters that stay letters, which neither moves a word's edge nor makes a phrase.
    return F.lower(F.coalesce(text, F.lit("")))


def _spaced(lowered: Column) -> Column:
    """Words with one space before, between and after; one space without words."""
    words = F.trim(F.regexp_replace(lowered, SEPARATOR, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(value: Column) -> Column:
    return F.octet_length(value) - F.octet_length(F.replace(value, F.lit(" ")))


def scan_phrases(spaced: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """Columns n_words, n_base, first_word, last_word and base_list over text as ``_spaced`` makes it."""
    words = _spaces(spaced) - 1
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        there = spaced.contains(f" {phrase} ")
        counts.append(F.when(there, F.regexp_count(spaced, F.lit(f"(?= {phrase} )"))).otherwise(0))
        at = F.instr(spaced, f" {phrase} ")
        firsts.append(F.when(there, _spaces(F.substring(spaced, F.lit(1), at)) - 1))
        back = F.reverse(spaced)
        after = _spaces(F.substring(back, F.lit(1), F.instr(back, f" {phrase} "[::-1]))) - 1
        lasts.append(F.when(there, words - after - len(phrase.split(" "))))
        labels.append(F.when(there, F.lit(label)))
    least = (lambda c: F.least(*c)) if len(firsts) > 1 else (lambda c: c[0])
    most = (lambda c: F.greatest(*c)) if len(lasts) > 1 else (lambda c: c[0])
    return {
        "n_words": words.cast("long"),
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": least(firsts).cast("long"),
        "last_word": most(lasts).cast("long"),
        "base_list": F.array_compact(F.array(*labels)),
    }


def word_order(lowered: DataFrame, words: list[str]) -> list[str]:
    """``words``, rarest in the whole corpus first (ties by spelling)."""
    known = lowered.sparkSession.createDataFrame([(w,) for w in words], "word string")
    met = lowered.select(F.explode(F.split("lowered", SEPARATOR)).alias("word")).join(_small(known, len(words)), "word").groupBy("word").count()
    counts = {r["word"]: r["count"] for r in met.collect()}  # a row a template word
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _one_spelling(lowered: Column) -> Column:
    for first, second, put in SPELLINGS:
        lowered = F.when(lowered.contains(first), F.regexp_replace(lowered, rf"\b{first}{SEPARATOR}{second}\b", put)).otherwise(lowered)
    return lowered


def match_templates(lowered: DataFrame, keys: list[str], templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``keys``, ``label``, ``share``: for every row with a matching window, its labels and their best containment."""
    lowered = lowered.select(*keys, _one_spelling(F.col("lowered")).alias("lowered"))
    sets = [(label, sorted(set(text.split(" "))), math.ceil(SPREAD * len(text.split(" ")))) for label, text in templates]
    order = word_order(lowered, sorted({w for _, s, _ in sets for w in s}))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words, width in sets:
        need = math.ceil(contained * len(words) - 1e-9)
        marks, foreign = MARKS.get(label, ((), ()))
        marks, foreign = [w for w in marks if w in words], [w for w in foreign if w not in words]
        rows += [(w, label, words, marks, foreign, need, width) for w in sorted(words, key=rank.get)[: len(words) - need + 1]]
    prefixes = lowered.sparkSession.createDataFrame(rows, "prefix string, label string, template array<string>, marks array<string>, foreign array<string>, need int, width int")
    prefix_words, reach = sorted({r[0] for r in rows}), max(r[-1] for r in rows)

    texts = lowered.select(*keys, F.split("lowered", SEPARATOR).alias("words")).where(F.arrays_overlap("words", _strings(prefix_words)))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(prefix_words), i)), lambda i: i.isNotNull())
    # The words that a window over the place may have, from the array's start or ``width - 1`` words before on.
    within = lambda words, at, width: F.slice(words, F.greatest(at - width + 2, F.lit(1)), F.least(at, width - 1) + width)
    spans = F.transform(places, lambda at: F.struct(F.element_at("words", at + 1).alias("prefix"), F.least(at, F.lit(reach - 1)).alias("place"), within("words", at, F.lit(reach)).alias("near")))
    met = texts.select(*keys, F.explode(spans).alias("span")).select(*keys, "span.*").join(_small(prefixes, len(rows)), "prefix")
    held = lambda words: F.when(F.size(F.array_except("marks", words)) == 0, F.size(F.array_intersect("template", words)))
    met = met.where(held(within("near", F.col("place"), F.col("width"))) >= F.col("need"))
    other = lambda side: F.transform("near", lambda w, i: F.when(side(i) & F.array_contains("foreign", w), i))
    met = met.select("*", F.coalesce(F.array_max(other(lambda i: i < F.col("place"))) + 1, F.lit(0)).alias("first"), F.coalesce(F.array_min(other(lambda i: i > F.col("place"))), F.size("near")).alias("end"))
    met = met.select(*keys, "label", "template", "marks", "need", "width", (F.col("place") - F.col("first")).alias("place"), F.slice("near", F.col("first") + 1, F.col("end") - F.col("first")).alias("near"))
    starts = F.sequence(F.greatest(F.col("place") - F.col("width") + 2, F.lit(1)), F.col("place") + 1)
    best = met.select(*keys, "label", "template", "need", F.array_max(F.transform(starts, lambda s: held(F.slice("near", s, F.col("width"))))).alias("best"))
    return best.where("best >= need").groupBy(*keys, "label").agg(F.max(F.col("best") / F.size("template")).alias("share"))


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    hashed = docs.select(F.col(quoted(id)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("hash"), _lower(F.col(quoted(text))).alias("lowered"))
    matched = match_templates(hashed, ["doc_id", "hash"], templates, contained)
    matched = cut_lineage(matched.groupBy("doc_id", "hash").agg(F.collect_set("label").alias("found"), F.max("share").alias("share")))
    found = scan_phrases(F.col("spaced"), phrases)
    base = hashed.select("doc_id", "hash", _spaced(F.col("lowered")).alias("spaced")).select("doc_id", "hash", *[c.alias(n) for n, c in found.items()])
    joined = base.join(matched.select(F.col("doc_id").alias("m_id"), F.col("hash").alias("m_hash"), "found", "share"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash")), "left")
    own = F.coalesce("found", F.array().cast("array<string>"))
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        named(F.col("base_list")).alias("base_labels"), named(F.concat("base_list", own)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
