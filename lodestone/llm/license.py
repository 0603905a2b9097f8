"""License scans by diagonal voting, on DataFrame operations alone.

All rolling word k-gram hashes of the texts meet the positions of the templates' k-grams in an
equi-join, a broadcast one while there are few templates. A meeting votes for the diagonal
(text position - template position) of its template; neighbouring diagonals merge, so that words
put in or left out don't break a place; and a place is verified: its score is the longest run of
meetings that goes forward in both text and template within a bounded total drift. Only meetings
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import spread
from .common import materialize

#: Words to find exactly, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own templates: whole license sentences, found with some words changed.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gfdl": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words of a k-gram, template k-grams up to which they are broadcast (more are shuffled), and the share of a
#: template that a place must have.
K, BROADCAST_GRAMS, SHARE = 2, 100_000, 0.8
#: Diagonals that merge: so many words may have been put in or left out.
DRIFT = 3
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates(spark, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    rows = []
    for kind, group in (("base", phrases.items()), ("own", ((v, k) for k, v in templates.items()))):
        for text, label in group:
            words = text.split(" ")
            if len(words) < K:
                raise ValueError(f"a template needs {K} words")
            rows += [(kind, label, text, len(words), j, " ".join(words[j : j + K])) for j in range(len(words) - K + 1)]
    out = spark.createDataFrame(rows, "kind string, label string, template string, m int, j int, gram string")
    out = out.select("*", *(F.split_part("gram", F.lit(" "), F.lit(e + 1)).alias(f"t{e}") for e in range(K))).withColumn("h", F.xxhash64(*(f"t{e}" for e in range(K))))
    return F.broadcast(out) if len(rows) <= BROADCAST_GRAMS else out.hint("shuffle_merge")


def _row(id_col: str, text_col: str) -> Column:
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), text_col, id_col).alias("b")).alias("row")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """The meetings of text k-grams and template k-grams: (row, kind, label, template, m, j, i,
    diagonal), where row names a document by 128 bits of its id and text, i and j are word positions.

    Texts are lower-cased; words are runs of letters, digits and non-ASCII characters. A base
    phrase counts wherever its words stand consecutively. A template counts where at least SHARE of
    its k-grams stand in order, on diagonals that make a chain of gaps of DRIFT at most and lie within
    half the template's length of each other (DRIFT at least). Null texts are empty. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    # lower() maps no character but A-Z and the Kelvin sign to an ASCII letter; no phrase word has a k
    words = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _BREAK)
    texts = spread(docs.select(id_col, text_col)).select(_row(id_col, text_col), words.alias("all"))
    # a text that begins or ends with a break has an empty string there
    lead, trail = (F.when(F.element_at("all", e) == "", 1).otherwise(0) for e in (1, -1))
    inner = F.slice("all", lead + 1, F.greatest(F.size("all") - lead - trail, F.lit(0)))
    texts = texts.select("row", inner.alias("w0"))
    shifted = texts.select("row", "w0", *(F.slice("w0", F.lit(1 + e), F.greatest(F.size("w0") - e, F.lit(0))).alias(f"w{e}") for e in range(1, K)))
    gram = [f"w{e}" for e in range(K)]
    at = shifted.select("row", F.posexplode(F.arrays_zip(*gram)).alias("i", "g")).select("row", "i", *(F.col(f"g.{w}").alias(w) for w in gram))
    t = _templates(spark, phrases, templates)
    same = F.xxhash64(*gram) == F.col("h")
    for e in range(K):
        same &= F.col(f"w{e}") == F.col(f"t{e}")
    return at.join(t, same).select("row", "kind", "label", "template", "m", "j", "i", (F.col("i") - F.col("j")).alias("diagonal"))


def _in_order(positions: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an array (by least last entries)."""

    def step(ends: Column, x: Column) -> Column:
        n = F.size(F.filter(ends, lambda e: e < x))
        return F.concat(F.slice(ends, F.lit(1), n), F.array(x), F.slice(ends, n + 2, F.greatest(F.size(ends) - n - 1, F.lit(0))))

    return F.aggregate(positions, F.array().cast("array<int>"), step, F.size)


def places(met: DataFrame) -> DataFrame:
    """(row, kind, label, start, hit) from the distinct meetings of `scan`; hit is the share of the
    template's k-grams found there in order."""
    votes = met.groupBy("row", "kind", "label", "template", "m", "diagonal").agg(F.count("*").alias("votes"), F.min("i").alias("start"))
    exact = votes.where((F.col("kind") == "base") & (F.col("votes") == F.col("m") - (K - 1)))
    exact = exact.select("row", "kind", "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("hit"))
    # neighbouring diagonals: a chain of gaps of DRIFT words at most is one place
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    chain = votes.where(F.col("kind") == "own").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(own) > DRIFT).cast("int"))
    chain = chain.withColumn("place", F.sum(F.coalesce("new", F.lit(0))).over(own))
    merged = chain.groupBy("row", "template", "m", "place").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    grams = F.col("m") - (K - 1)
    merged = merged.where(F.col("votes") / grams >= SHARE).select("row", "template", "place", "low", "high")
    # each span of diagonals within the total drift; a meeting lies in as many as the drift is wide
    t, p = met.where(F.col("kind") == "own").alias("t"), merged.alias("p")
    inside = (F.col("t.row") == F.col("p.row")) & (F.col("t.template") == F.col("p.template")) & F.col("diagonal").between(F.col("low"), F.col("high"))
    drift = F.greatest(F.lit(DRIFT), F.floor(F.col("m") / 2).cast("int"))
    spans = t.join(p, inside).select("t.*", "place", F.explode(F.sequence(F.greatest("low", F.col("diagonal") - drift), F.col("diagonal"))).alias("span"))
    # of meetings in the same text word the later template word comes first, so that only one counts
    spans = spans.groupBy("row", "kind", "label", "template", "m", "place", "span").agg(F.collect_list(F.struct("i", (-F.col("j")).alias("back"))).alias("at"), F.min("i").alias("start"))
    share = _in_order(F.transform(F.array_sort("at"), lambda x: -x["back"])) / grams
    verified = spans.withColumn("hit", share).where(F.col("hit") >= SHARE).groupBy("row", "kind", "label", "template", "place").agg(F.max(F.struct("hit", (-F.col("start")).alias("back"))).alias("best"))
    verified = verified.select("row", "kind", "label", (-F.col("best.back")).alias("start"), F.col("best.hit").alias("hit"))
    return exact.unionByName(verified)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best share of a template found; 1 where a base phrase stands).

    An empty table gives no rows; see `scan` for texts. Repeated rows each get their own row.
    """
    met = scan(docs, id_col, text_col, phrases, templates)
    # one pass over the texts: the word counts and the few meetings are kept, not the words
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), _row(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    n_words = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    found = places(materialize(met.distinct(), "met"))
    base = F.col("kind") == "base"
    labels = found.groupBy("row").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("hit").alias("score"),
    )
    rows = rows.select("id", "row", n_words.alias("n_words"))
    out = rows.join(labels, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"))
