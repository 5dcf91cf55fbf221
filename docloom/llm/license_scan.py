"""License scans by an exact set-similarity join of text blocks with templates, in DataFrame operations only.

A block is a line, or a paragraph of several lines (between empty ones). It meets a template if it has at least
ceil(THRESHOLD * size) of the template's distinct words, so that at most size - ceil(THRESHOLD * size) of them are missing:
of any one word more than that, the text has one. Texts without any of the longest such words, searched for as plain
substrings, have no such block and are not cut into words. Only words of templates can be shared, so that blocks are cut
down to those, ordered by their frequency over all blocks of the other texts, rarest first. A pair that meets the threshold
shares a word of both prefixes whose places leave room for the rest; such pairs are compared in full.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_table, text_of, written

#: What separates words, in either case.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{SEPARATORS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that name a license by themselves.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A sentence of each usual notice, with its label.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("agpl", "This program is licensed under the GNU Affero General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
)
THRESHOLD = 0.9


def _pattern(phrase: str) -> str:
    """A phrase as whole words with anything but words between them; letters of ASCII in either case."""
    between = f"[{SEPARATORS}]+"
    return f"(?<![^{SEPARATORS}]){between.join(phrase.split())}(?![^{SEPARATORS}])"


def _words(text: str) -> list[str]:
    """The distinct words of a template."""
    import re

    return sorted(set(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))))


def needed(templates, threshold: float) -> list[str]:
    """Words of which a text with a block that meets one of the templates has at least one: of each the longest, one more than may be missing."""
    out = set()
    for _, template in templates:
        words = sorted(_words(template), key=lambda w: (-len(w), w))
        out |= set(words[: len(words) - math.ceil(threshold * len(words)) + 1])
    return sorted(out)


def may_hold(text: Column, words: list[str]) -> Column:
    """Whether a text has one of these words, also as part of others, in any case. Of words with other letters their ASCII counts, as lower() changes more."""
    import re

    parts = [max(re.findall("[\x00-\x7F]*", w), key=len) for w in words]
    return F.exists(F.array(F.lower(text)), lambda low: functools.reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in parts)))  # lower() once


ANYWHERE = "(?is)(?:" + "|".join(map(_pattern, PHRASES)) + ")"


def has_phrase(text: Column) -> Column:
    return may_hold(text, needed([(label, phrase) for phrase, label in PHRASES.items()], 1.0)) & text.rlike(ANYWHERE)


def base_columns(text: Column, found: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word, base (sorted labels) of a text that is not null; found is has_phrase() of it."""
    anywhere = ANYWHERE
    count = lambda pattern, x=text: F.regexp_count(x, F.lit(pattern)).cast("long")
    # A letter for each word with all around it: no word becomes a string of its own.
    letters = F.regexp_replace(text, f"[{SEPARATORS}]*{WORD}[{SEPARATORS}]*", "x")
    some = lambda x, none=None: F.when(found, x).otherwise(none)
    labels = [F.when(text.rlike("(?i)" + _pattern(p)), F.lit(label)) for p, label in PHRASES.items()]
    return {
        "n_words": F.when(text.rlike(WORD), F.length(letters)).otherwise(0).cast("long"),
        "n_base": some(count(anywhere), F.lit(0).cast("long")),
        "first_word": some(count(WORD, F.split(text, anywhere, 2)[0])),
        "last_word": some(count(WORD, F.regexp_extract(text, "(?is)\\A(.*)(?:" + "|".join(map(_pattern, PHRASES)) + ")", 1))),
        "base": some(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), F.array().cast("array<string>")),
    }


def blocks(docs: DataFrame, text: str, words: list[str], at_least: int) -> DataFrame:
    """(digest, found): the distinct words among `words` of each line, and of each paragraph of several, that has so many; digest is of the text."""
    vocabulary = F.lit(words)
    found = lambda line: F.array_intersect(F.regexp_extract_all(F.translate(line, UPPER, LOWER), F.lit(WORD), F.lit(0)), vocabulary)
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), F.explode(F.split(text, r"\n(?:[ \t\x0B\f\r]*\n)+")).alias("paragraph"))
    rows = rows.select("digest", F.transform(F.split("paragraph", "\n"), found).alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.array_distinct(F.flatten("lines")))).otherwise(F.array().cast("array<array<string>>"))
    return rows.select("digest", F.explode(F.concat("lines", whole)).alias("found")).where(F.size("found") >= at_least)


def containment_join(found: DataFrame, templates, threshold: float) -> DataFrame:
    """(digest, label, containment): every block of `found` and template that meet the threshold.

    `found` is from blocks(), with all words of all templates. The driver sees how often each of these words occurs.
    """
    spark = found.sparkSession
    counts = dict(found.select(F.explode("found").alias("word")).groupBy("word").count().collect())  # one row per word of a template
    order = sorted({w for _, t in templates for w in _words(t)}, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for label, template in templates:
        words = sorted(_words(template), key=place.get)
        need = math.ceil(threshold * len(words))
        index += [(w, i, label, words, need) for i, w in enumerate(words[: len(words) - need + 1])]
    least = min(need for *_, need in index)
    prefixes = F.broadcast(spark.createDataFrame(index, "word string, i int, label string, template array<string>, need int"))  # bounded by the templates
    ordered = found.select("digest", F.array_intersect(F.lit(order), "found").alias("words"))
    heads = ordered.select("digest", "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - least + 1)).alias("j", "word"))
    room = 1 + F.least(F.size("template") - F.col("i"), F.size("words") - F.col("j")) - 1
    near = heads.join(prefixes, "word").where((F.size("words") >= F.col("need")) & (room >= F.col("need")))
    shared = F.size(F.array_intersect("words", "template"))
    return near.where(shared >= F.col("need")).select("digest", "label", (shared / F.size("template")).alias("containment"))


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of a template that some block meets, 1 where a phrase of PHRASES stands, else 0. A
    null or empty text has no words and no labels. Whole texts are read, however long; ids may be null or repeat and equal rows stay, as
    labels are found by text. An empty table gives an empty result. Other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text).cast("string").alias("text"))
    words = sorted({w for _, t in templates for w in _words(t)})
    at_least = min(math.ceil(threshold * len(_words(t))) for _, t in templates)
    some = rows.where(may_hold(F.col("text"), needed(templates, threshold)))
    met = containment_join(written(blocks(some, "text", words, at_least)), templates, threshold)
    labels = met.groupBy("digest").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))  # at most one per label
    told = rows.select("doc_id", "text", has_phrase(F.col("text")).alias("phrase"))
    plain = told.select("doc_id", F.unhex(F.sha2("text", 256)).alias("of"), *(c.alias(n) for n, c in base_columns(F.col("text"), F.col("phrase")).items()))
    out = join_table(written(plain).withColumn("spread", F.monotonically_increasing_id()), labels, "of", "digest", "left", "spread")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("more", none)))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def label(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """docs with a column license (_license, if there is one) of the labels of its text, null without any; edge cases as in scan()."""
    name = fresh(docs.columns, "license")
    key, of = (fresh([*docs.columns, name], x) for x in ("license_of", "license_digest"))
    whole = docs.withColumn(key, F.sha2(text_of(text), 256))
    found = scan(whole, text, key, **settings).where("labels <> ''").groupBy(F.col("doc_id").alias(of)).agg(F.first("labels").alias(name))
    return whole.join(found, F.col(key) == F.col(of), "left").drop(key, of)


def query(spark, sf_dir):
    """op13: whole `documents`."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """DuckDB SQL: phrases by places of words, templates by comparing each with all blocks."""
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    split = lambda x: f"regexp_extract_all({x}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {quoted(_words(t))})" for label, t in TEMPLATES)
    return rf"""
with d as (select row_number() over () as k, doc_id, {text} as body from documents),
w as (select k, doc_id, body, {split("body")} as words from d),
p(phrase, label) as (values {phrases}),
b as (select k, unnest(list_filter(range(0, len(words)), lambda i: list_slice(words, i + 1, i + len(phrase)) = phrase)) as start, label from w, p),
bs as (select k, count(*) as n_base, min(start) as first_word, max(start) as last_word, list_sort(list_distinct(list(label))) as base from b group by k),
t(label, template) as (values {templates}),
paragraphs as (select k, unnest(regexp_split_to_array(body, '\n(?:[ \t\x0B\f\r]*\n)+')) as paragraph from d),
lines as (select k, unnest(case when contains(paragraph, chr(10)) then list_append(string_split(paragraph, chr(10)), paragraph) else [paragraph] end) as line from paragraphs),
s as (select k, {split("line")} as words from lines),
m as (select k, label, len(list_intersect(template, words)) / len(template) as containment from s, t where len(list_intersect(template, words)) >= ceil({THRESHOLD} * len(template))),
ms as (select k, list_distinct(list(label)) as more, max(containment) as containment from m group by k)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(array_to_string(base, ','), '') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') as labels, case when n_base > 0 then 1.0 else coalesce(containment, 0.0) end::double as score
from w left join bs using (k) left join ms using (k)
"""


ORACLE = _oracle()
