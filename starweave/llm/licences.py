"""Licence scan: TF-IDF cosine of passages to templates, inherited along directories.

Passages (lines and sentences) and templates become sparse vectors over
words.  The best template above a threshold is a file's own licence; a text
that is a whole licence text, by cosine of its set of words, has that
licence.  A licence file gives its directory a licence, and files without
their own take that of the nearest ancestor directory that has one.  All of it is DataFrame
operations; nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from starweave.llm.common import staged
from starweave.llm.licence_texts import FULL_TEXTS

# Wording of public licence notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Cosine at least; cosine of a whole text at least.
THRESHOLD, FULL_THRESHOLD = 0.7, 0.85
#: Names of licence files, of any length.
NAMED = r"(?i)(^|/)([a-z0-9]+-)?(licen[cs]e|copying|unlicen[cs]e)(-[^/.]*(\.[0-9]+)*|\.lesser)?(\.(txt|md|rst))?$"
#: What parts passages, and what parts words after A-Z became a-z.
PASSAGES, WORDS = r"\n|[.!?]+ ", "[^a-z0-9]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), WORDS), lambda w: w != "")


def _template_words(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``template, word, tf``."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    return rows.select("template", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "word").agg(
        F.count(F.lit(1)).alias("tf")
    )


def template_weights(texts: DataFrame, templates: dict[str, str]) -> tuple[DataFrame, float]:
    """``word, idf`` of the templates' words over all texts, and the idf of a word that no template has.

    The result has one row for each word of the templates.  idf is
    ln((1 + documents) / (1 + documents with the word)) + 1; a word
    outside the templates counts as one that a single document has.
    """
    known = _template_words(texts.sparkSession, templates).select("word").distinct()
    vocabulary = sorted(r["word"] for r in known.collect())
    listed = F.array(*[F.lit(w) for w in vocabulary])
    has = F.array_intersect(words(F.coalesce("text", F.lit(""))), listed)
    counts = texts.select(F.explode(F.array_union(has, F.array(F.lit("")))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df")
    ).collect()
    df = {r["word"]: r["df"] for r in counts}
    n = df.get("", 0)
    rows = [(w, df.get(w, 0), n) for w in vocabulary]
    frame = texts.sparkSession.createDataFrame(rows, "word string, df long, n long")
    return frame.withColumn("idf", F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0), math.log((1.0 + n) / 2.0) + 1.0


def _within_reach(words: Column, idf: dict[str, float], other: float, threshold: float) -> Column:
    """Whether a passage's words allow a cosine of the threshold to any template.

    No cosine is above the share that the template words have in the
    passage's norm.  Every further word adds the square of ``other`` at
    least, so a passage left out cannot reach the threshold.
    """
    least = max(0.0, min(threshold, 1.0) - 1e-6)  # scores are rounded
    each = least**2 / (1 - least**2) * other**2
    weights = F.create_map(*[F.lit(x) for item in sorted(idf.items()) for x in item])

    def reached(all_: Column, known: Column) -> Column:
        inside = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda s, w: s + F.pow(
            F.size(F.filter(known, lambda x: x == w)) * weights[w], F.lit(2.0)
        ))
        return (F.size(known) > 0) & (inside >= each * (F.size(all_) - F.size(known)))

    return _let(words, lambda all_: _let(
        F.filter(all_, lambda w: w.isin(*sorted(idf))), lambda known: reached(all_, known)
    ))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def own_licences(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``path, licence, score`` of the files with a passage like a template: the likeliest template.

    Every passage is scored that can reach the threshold by the share of
    template words in its norm, however many files have these words.  Equal
    scores go to the template first by name.  Null texts have no passage;
    rows that repeat a path count as one file with all their passages.
    """
    templates = templates or TEMPLATES
    texts = files.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    idf, other = template_weights(texts, templates)
    known = {r["word"]: r["idf"] for r in idf.collect()}
    vectors = _template_words(files.sparkSession, templates).join(F.broadcast(idf), "word").select(
        "template", "word", (F.col("tf") * F.col("idf")).alias("weight")
    )
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    template = vectors.join(F.broadcast(norms), "template").select("template", "word", (F.col("weight") / F.col("norm")).alias("unit"))
    passages = (
        texts.select("path", F.explode(F.split("text", PASSAGES)).alias("passage"))
        .select("path", words(F.col("passage")).alias("words"))
        .where(_within_reach(F.col("words"), known, other, threshold))
        .withColumn("passage", F.struct(F.xxhash64("words"), F.md5(F.array_join("words", " "))))
    )
    terms = passages.select("path", "passage", F.explode("words").alias("word")).groupBy("path", "passage", "word").agg(
        F.count(F.lit(1)).alias("tf")
    )
    weighted = terms.join(F.broadcast(idf.select("word", "idf")), "word", "left").withColumn(
        "weight", F.col("tf") * F.coalesce("idf", F.lit(other))
    )
    length = Window.partitionBy("path", "passage")
    scored = (
        weighted.withColumn("norm", F.sqrt(F.sum(F.col("weight") ** 2).over(length)))
        .join(F.broadcast(template), "word")
        .groupBy("path", "passage", "template")
        .agg(F.round(F.sum(F.col("weight") * F.col("unit")) / F.first("norm"), 6).alias("score"))
        .where(F.col("score") >= threshold)
    )
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("score"), "template")).alias("best"))
    return best.select("path", F.col("best.template").alias("licence"), (-F.col("best.score")).alias("score"))


def whole_licence(text: Column, full: dict[str, str] | None = None, threshold: float = FULL_THRESHOLD) -> Column:
    """``score, licence`` of the licence text that a whole text is, the score negative; else null.

    The score is the cosine of the sets of words.  A cosine of t needs t**2
    of the text's words in the licence texts and bounds the number of
    words on both sides, so what is left out before cannot reach it.
    """
    full = {name: sorted(set(listed.split())) for name, listed in (full or FULL_TEXTS).items()}
    vocabulary = sorted(set().union(*full.values()))
    share = threshold**2
    sizes = [len(listed) for listed in full.values()]

    def best(own: Column) -> Column:
        scores = F.array(*[
            F.struct((-F.round(
                F.size(F.array_intersect(own, F.split(F.lit(" ".join(listed)), " "))) / F.sqrt(F.size(own) * F.lit(float(len(listed)))), 6
            )).alias("score"), F.lit(name).alias("licence"))
            for name, listed in sorted(full.items())
        ])
        return F.array_min(F.filter(scores, lambda x: x["score"] <= -threshold))

    return _let(F.array_distinct(words(text)), lambda own: F.when(
        F.size(own).between(math.floor(share * min(sizes)), math.ceil(max(sizes) / share))
        & (F.size(F.filter(own, lambda w: w.isin(*vocabulary))) >= share * F.size(own) - 1), best(own)
    ))


def filled_passages(text: Column) -> Column:
    """Passages with a word in them; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, PASSAGES), lambda p: p.rlike("[A-Za-z0-9]"))), F.lit(0))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last, as ``depth, directory``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")
    ))


def scan_licences(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD, full: dict[str, str] | None = None,
) -> DataFrame:
    """``path, licence, score, origin, directory`` of every path.

    ``origin`` is ``own``, ``inherited`` or ``none``; ``directory`` is the
    one inherited from.  A text that is a whole licence text (``full``: the
    words of each) has that licence, whatever single sentences say.  Licence
    files are such texts and, with their own licence, files whose name says
    so and files that hold nothing but one passage, whatever their length.
    Of several in a directory the former two go first, then the best score
    counts, then the first path.  Licences of directories are joined by
    directory name; hot directories are on the side that is streamed.  A
    path without a directory inherits nothing; null paths are one row without
    licence.
    """
    own = own_licences(files, path_col, text_col, templates, threshold)
    text = F.col(text_col).cast("string")
    sizes = files.select(
        F.col(path_col).alias("path"), filled_passages(text).alias("size"), whole_licence(text, full).alias("whole")
    )
    listed = staged(
        sizes.groupBy("path").agg(F.sum("size").alias("size"), F.min("whole").alias("whole")).join(own, "path", "left").select(
            "path", F.coalesce("whole.licence", "licence").alias("licence"), F.coalesce(-F.col("whole.score"), "score").alias("score"), "size",
            F.when(F.col("whole").isNotNull() | F.col("path").rlike(NAMED), 0).when(F.col("size") == 1, 1).alias("gives"),
        ),
        "listed",
    )
    directory = F.expr("substring_index(path, '/', size(split(path, '/')) - 1)")
    given = (
        listed.where(F.col("licence").isNotNull() & F.col("gives").isNotNull() & F.col("path").contains("/"))
        .withColumn("directory", directory).groupBy("directory")
        .agg(F.min(F.struct("gives", (-F.col("score")).alias("score"), "path", "licence")).alias("best"))
        .select("directory", F.col("best.licence").alias("given"))
    )
    bare = listed.where(F.col("licence").isNull() & F.col("path").contains("/"))
    nearest = (
        bare.select("path", F.explode(ancestors(F.col("path"))).alias("up")).select("path", "up.depth", "up.directory")
        .join(given, "directory")
        .groupBy("path").agg(F.max(F.struct("depth", "directory", "given")).alias("up"))
        .select("path", F.col("up.directory").alias("directory"), F.col("up.given").alias("given"))
    )
    return listed.join(nearest, "path", "left").select(
        "path", F.coalesce("licence", "given").alias("licence"), "score",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "directory",
    )
