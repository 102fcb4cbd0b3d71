"""License scans by diagonal voting, in DataFrame operations only.

Templates are cut into rolling word pairs; so is every text. A join of the hashes gives hits
(place in the text, template, place in the template). The difference of the two places is the
diagonal: words of one copy of a template vote for the same one. Votes are counted per
diagonal, neighbouring diagonals (a word inserted or left out) are merged, and the spans found
are verified: a phrase must be there word for word, a longer template with enough of its pairs,
each counted once and in the template's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import documents, stored

# Phrases and their labels (fixed values). Every place counts.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Well-known sentences of licenses and their labels (fixed values), found also with small changes.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gnu",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "spdx license identifier": "spdx",
}

WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words
SLACK = 2  # words by which the diagonals of one copy may differ at most
COVER = 0.6  # share of a sentence's pairs that makes a match


def text_parts(text: F.Column) -> F.Column:
    """Words of a lower-cased text, with an empty part at an end where no word is.

    Only A-Z matter: other letters keep being letters in lower case. The one sign that would
    turn into an ASCII letter, the Kelvin sign, is replaced by another letter first.
    """
    return F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), WORDS)


def lead(parts: F.Column) -> F.Column:
    """Number of empty parts before the first word."""
    return (F.get(parts, F.lit(0)) == "").cast("int")


def count_words(parts: F.Column) -> F.Column:
    size = F.size(parts)
    return size - lead(parts) - ((size > 1) & (F.get(parts, size - 1) == "")).cast("int")


def pair_hashes(words: F.Column) -> F.Column:
    """Hash of each word with the next one; the last word stands alone and is no pair."""
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(words, following, lambda a, b: F.xxhash64(a, b))


def template_pairs(spark, phrases: dict[str, str], sentences: dict[str, str]) -> DataFrame:
    """Rows (hash, template, label, exact, at, pairs, words): a row per word pair of a template."""
    rows = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in sentences.items()]
    templates = spark.createDataFrame(rows, "template string, label string, exact boolean")
    words = templates.withColumn("words", F.split("template", " "))
    return words.select(
        F.posexplode(pair_hashes(F.col("words"))).alias("at", "hash"),
        "template",
        "label",
        "exact",
        "words",
        (F.size("words") - 1).alias("pairs"),
    ).where("at < pairs")


def _in_order(run: F.Column) -> F.Column:
    """How many pairs of a template (sorted by their place in it) follow each other in the text."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(-1).alias("place"))

    def step(held: F.Column, pair: F.Column) -> F.Column:
        later = (pair["at"] > held["at"]) & (pair["place"] > held["place"])
        took = F.struct((held["n"] + 1).alias("n"), pair["at"].alias("at"), pair["place"].alias("place"))
        return F.when(later, took).otherwise(held)

    return F.aggregate(run, start, step)["n"]


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, cover: float = COVER
) -> DataFrame:
    """Licence phrases and sentences in texts.

    ``docs`` has doc_id and text. Returns one row per row: doc_id, n_words, n_base (places of
    phrases), first_word and last_word (smallest and largest start of a phrase, from 0; else
    null), base_labels and labels (distinct, sorted, comma-joined; the latter with those of
    sentences), score (share of the best template's pairs that was found, 0 to 1).

    Null texts count as empty: no words, no places, empty labels, score 0. Null and repeated
    ids are fine: results belong to a text, and equal rows get equal results. An empty table
    gives an empty one. Templates have at least two words; there are few, so they are
    broadcast.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = ["text_hash", "text_length"]
    named = base.select(F.xxhash64("text").alias("text_hash"), F.length("text").alias("text_length"), "text")
    parts = named.select(*text, text_parts(F.col("text")).alias("parts"))
    grams = parts.select(*text, "parts", pair_hashes(F.col("parts")).alias("grams"))
    templates = template_pairs(spark, phrases, sentences)
    wanted = [r[0] for r in templates.select("hash").distinct().collect()]  # a few hundred numbers
    # An outer explode, as an inner one would have the pairs computed once more to test for none.
    hits = (
        grams.select(*text, "parts", F.posexplode_outer("grams").alias("part", "hash"))
        .where(F.col("hash").isin(wanted))
        .join(F.broadcast(templates), "hash")
        .withColumn("diagonal", F.col("part") - F.col("at") - lead(F.col("parts")))
    )
    # What the text has where the template's pair stands: a hash alone proves nothing.
    real = (F.get("parts", F.col("part")) == F.get("words", F.col("at"))) & (
        F.get("parts", F.col("part") + 1) == F.get("words", F.col("at") + 1)
    )
    votes = stored(
        hits.where(real)
        .groupBy(*text, "template", "label", "exact", "pairs", "diagonal")
        .agg(F.collect_set("at").alias("ats"))  # at most the pairs of the template
        .withColumn("votes", F.size("ats"))
    )
    places = votes.where(F.col("exact") & (F.col("votes") == F.col("pairs")))
    places = places.groupBy(*text).agg(
        F.count("*").alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.collect_set("label").alias("base"),
    )
    # Diagonals of a sentence that differ by at most SLACK are one copy with words put in or left out.
    near = Window.partitionBy(*text, "template").orderBy("diagonal").rangeBetween(0, SLACK)
    places_of = F.transform("ats", lambda a: F.struct(a.alias("at"), (a + F.col("diagonal")).alias("place")))
    copies = (
        votes.where(~F.col("exact"))
        .withColumn("run", F.array_sort(F.flatten(F.collect_list(places_of).over(near))))
        .withColumn("share", _in_order(F.col("run")) / F.col("pairs"))
        .where(F.col("share") >= cover)
        .groupBy(*text)
        .agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    )
    parts = base.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.length("text").alias("text_length"),
        text_parts(F.col("text")).alias("parts"),
    )
    counted = parts.select(
        "doc_id",
        *text,
        count_words(F.col("parts")).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    return (
        counted.join(places, text, "left")
        .join(copies, text, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("more", none))), ",").alias("labels"),
            F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )


def op8_license_diagonals(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
