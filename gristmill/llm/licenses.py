"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a line, or a run of consecutive words across line ends, since notices wrap: as many words
as the template has, divided by THRESHOLD, so that it may hold as many foreign words as it may miss.
A block's set and a template's are distinct words. Template words are ordered by how many lines of
the corpus hold them, rarest first. A block that holds the share THRESHOLD of a
template's n words must hold one of the n - need + 1 rarest (prefix filter), has at least `need`
words (length filter), and has enough words left after the first common one (positional filter).
What passes is verified on the whole sets.

Some notices' words are all among another's ("CC BY 4.0" in "CC BY-NC 4.0"). A block that holds the
other's further words too is that other licence and no match of the plain one.

Runs of words are looked at only around the prefix words, of which each match holds one.

Scale: one scan reduces each line to its template words, a second cuts the surroundings of prefix
words. Templates are a fixed list, so the inverted index of their prefixes is broadcast; every join
after the scans is narrow, and only verified matches are shuffled, to their documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import alnum_words, ascii_lower, text_or_empty, written

THRESHOLD = 0.9
#: Fixed phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices in their usual wording, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)
#: Score of a document that has a phrase but no whole notice.
PHRASE_SCORE = 0.5


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def guards(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[list[list[str]]]:
    """By template, for each other one of another label with all of its words: the other's further words."""
    sets = [(label, set(_words(t))) for label, t in templates]
    return [[sorted(more - own) for other, more in sets if other != label and own < more] for label, own in sets]


def _other(block: Column) -> Column:
    """Whether the block is another licence's: it holds all further words of one of its guards."""
    return F.exists("guards", lambda g: F.size(F.array_except(g, block)) == 0)


def blocks(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _h, block, n_set, held): each line with template words; n_set: its distinct words; held: those of the vocabulary."""
    lines = F.split(ascii_lower(text_or_empty(text)), "\n")
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_h"), F.posexplode(lines).alias("block", "_line"))
    rows = rows.select("_key", "_h", "block", alnum_words(F.col("_line")).alias("_w"))
    # array_intersect keeps each common word once
    rows = rows.select("_key", "_h", "block", "_w", F.array_intersect("_w", F.array(*[F.lit(w) for w in vocabulary])).alias("held"))
    return rows.where(F.size("held") > 0).select("_key", "_h", "block", F.size(F.array_distinct("_w")).alias("n_set"), "held")


def prefixes(held: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> tuple:
    """(sets (t, label, words), rank of each word, needed words by t, prefix entries (w, p, size, need with t))."""
    sets = [(i, label, sorted(set(_words(t)))) for i, (label, t) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    count = dict(held.select(F.explode("held").alias("w")).groupBy("w").count().collect())  # one row for each template word
    rank = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    need = {i: max(1, -int(-threshold * len(ws) // 1)) for i, _, ws in sets}
    return sets, rank, need, [(i, w, p, len(ws), need[i]) for i, _, ws in sets for p, w in enumerate(sorted(ws, key=rank.get)[: len(ws) - need[i] + 1])]


def join_templates(held: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, prefixed: tuple | None = None) -> DataFrame:
    """(_key, _h, block, label, containment) of every line that holds at least the threshold of a template's words."""
    spark: SparkSession = held.sparkSession
    sets, rank, _, prefix = prefixed or prefixes(held, templates, threshold)
    vocabulary = sorted(rank)
    index = F.broadcast(spark.createDataFrame(prefix, "t int, w string, p int, size int, need int"))  # a fixed list
    full = F.broadcast(spark.createDataFrame([(i, label, ws, g) for (i, label, ws), g in zip(sets, guards(templates), strict=True)], "t int, label string, words array<string>, guards array<array<string>>"))
    order = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    rare = sorted({w for _, w, *_ in prefix})
    near = held.where(F.arrays_overlap("held", F.array(*[F.lit(w) for w in rare])))
    ranked = near.select("_key", "_h", "block", "n_set", "held", F.array_sort(F.transform("held", lambda w: F.struct(F.element_at(order, w).alias("r"), w.alias("w")))).alias("_s"))
    at = ranked.select("_key", "_h", "block", "n_set", "held", F.posexplode("_s").alias("q", "_e"))
    found = at.select("_key", "_h", "block", "n_set", "held", "q", F.col("_e.w").alias("w")).join(index, "w")
    found = found.where((F.col("n_set") >= F.col("need")) & (F.least(F.col("size") - F.col("p"), F.size("held") - F.col("q")) >= F.col("need")))
    both = found.join(full, "t").withColumn("common", F.size(F.array_intersect("held", "words"))).where((F.col("common") >= F.col("need")) & ~_other(F.col("held")))
    return both.select("_key", "_h", "block", "label", (F.col("common") / F.col("size")).alias("containment")).distinct()


def join_windows(docs: DataFrame, prefixed: tuple, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(_key, _h, label, containment) of every run of words, across line ends, that holds at least the threshold of a template's words."""
    spark = docs.sparkSession
    sets, _, need, prefix = prefixed
    width = {i: -int(-len(_words(t)) / threshold // 1) for i, (_, t) in enumerate(templates)}
    most = max(width.values())
    rare = F.array(*[F.lit(w) for w in sorted({w for _, w, *_ in prefix})])
    words, other = {i: ws for i, _, ws in sets}, guards(templates)
    index = F.broadcast(spark.createDataFrame([(w, i, sets[i][1], words[i], other[i], need[i], width[i]) for i, w, *_ in prefix], "w string, t int, label string, words array<string>, guards array<array<string>>, need int, width int"))  # a fixed list
    w = F.col("_w")
    df = docs.select(F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_h"), alnum_words(ascii_lower(text_or_empty(text))).alias("_w")).where(F.arrays_overlap("_w", rare))
    around = lambda i: F.struct(F.get(w, i).alias("w"), F.least(i, F.lit(most - 1)).alias("c"), F.slice(w, F.greatest(i - most + 2, F.lit(1)), F.least(i, F.lit(most - 1)) + most).alias("s"))
    places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(rare, x), i)), lambda i: i.isNotNull())
    near = df.select("_key", "_h", F.explode(F.transform(places, around)).alias("_e")).select("_key", "_h", "_e.*").join(index, "w")
    # the words from width - 1 before the prefix word to width - 1 after it
    near = near.withColumn("s", F.slice("s", F.greatest(F.col("c") - F.col("width") + 2, F.lit(1)), F.least(F.col("c"), F.col("width") - 1) + F.col("width")))
    near = near.where(F.size(F.array_intersect("s", "words")) >= F.col("need"))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - F.col("width") + 1, F.lit(1))), lambda i: F.slice("s", i, F.col("width")))
    common = F.array_max(F.transform(each, lambda run: F.when(_other(run), 0).otherwise(F.size(F.array_intersect(run, "words")))))
    both = near.withColumn("common", common).where(F.col("common") >= F.col("need"))
    return both.select("_key", "_h", "label", (F.col("common") / F.size("words")).alias("containment"))


def _phrase_at(words: Column, i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for j, w in enumerate(phrase.split(" ")):
        out = out & (F.get(words, i + j) == w)
    return F.coalesce(out, F.lit(False))


def phrase_places(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """Per row: _key, _h, n_words, n_base, first_word, last_word, base (the labels as an array)."""
    w = F.col("_w")
    df = docs.select(F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_h"), alnum_words(ascii_lower(text_or_empty(text))).alias("_w"))
    ends = list(dict.fromkeys(p.split(" ")[-1] for p, _ in phrases))
    starts = list(dict.fromkeys(p.split(" ")[0] for p, _ in phrases))
    maybe = F.arrays_overlap(w, F.array(*[F.lit(x) for x in starts])) & F.arrays_overlap(w, F.array(*[F.lit(x) for x in ends]))

    def place(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("int")
        for n, (phrase, _) in reversed(list(enumerate(phrases))):
            out = F.when((x == phrase.split(" ")[0]) & _phrase_at(w, i, phrase), n).otherwise(out)
        return F.when(out.isNotNull(), F.struct(i.cast("long").alias("at"), out.alias("n")))

    df = df.select("_key", "_h", "_w", maybe.alias("_maybe"))
    df = df.select("_key", "_h", F.size("_w").cast("long").alias("n_words"), F.when(F.col("_maybe"), F.array_compact(F.transform(w, place))).otherwise(F.array().cast("array<struct<at:bigint,n:int>>")).alias("_p"))
    labels = F.array(*[F.lit(label) for _, label in phrases])
    return df.select(
        "_key", "_h", "n_words", F.size("_p").cast("long").alias("n_base"),
        F.try_element_at("_p", F.lit(1))["at"].alias("first_word"), F.try_element_at("_p", F.lit(-1))["at"].alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("_p", lambda p: F.get(labels, p.n)))).alias("base"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels: those of the phrases and of the matching notices. score: the best containment of a notice,
    at least PHRASE_SCORE with a phrase, else 0. Word order within a block does not count, as the join is
    one of sets. A null text is empty. Repeated rows get equal results.
    """
    vocabulary = sorted({w for _, t in TEMPLATES for w in _words(t)})
    held = written(blocks(docs, vocabulary, key, text))
    prefixed = prefixes(held, threshold=threshold)
    found = join_templates(held, threshold=threshold, prefixed=prefixed).select("_key", "_h", "label", "containment").unionByName(join_windows(docs, prefixed, key, text, threshold=threshold))
    match = found.groupBy("_key", "_h").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = phrase_places(docs, key, text).alias("p").join(match.alias("m"), F.expr("p._key <=> m._key and p._h = m._h"), "left")
    labels = F.array_sort(F.array_union("p.base", F.coalesce("m.more", F.array().cast("array<string>"))))
    best = F.coalesce("m.best", F.lit(0.0))
    return out.select(
        F.col("p._key").alias(key), "p.n_words", "p.n_base", "p.first_word", "p.last_word", F.array_join("p.base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("p.n_base") > 0, F.greatest(best, F.lit(PHRASE_SCORE))).otherwise(best).alias("score"))
