"""Licence scans by a trained paragraph classifier, in DataFrame and SQL functions only.

Paragraphs are lines, long ones cut into overlapping pieces. A multinomial logistic regression tells licence
families from other text by the words and pairs of words that the templates have, and by how many other words
there are. It learns from variants of the templates below and from the paragraphs of all documents; those alike in
these are one row, weighed. How probable the best family must be is calibrated on
held-out paragraphs. A prediction counts for its family if the paragraph shares enough of the words, in
pairs, of one of its templates; a probable notice that matches no template is of an unknown licence.

A notice may run over several lines, over the cut of a long line, or stand inside other text. So places that
share enough pairs with a template are looked for in whole blocks of lines without a blank one between them,
and each is judged alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents

#: Notices as the licences or their stewards word them.
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class Settings:
    """Bounds and levels of the classifier."""

    variants: int = 60  # of each template
    piece: int = 60  # words of a paragraph judged at once
    step: int = 45
    false_rate: float = 0.001  # of held-out other paragraphs taken for notices
    shared: float = 0.75  # of a template's word pairs that confirm it


def lower_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}.+-]+|[.](?=[^\\p{L}\\p{N}]|$)"), lambda w: w != "")


def pieces(text: Column, how: Settings) -> Column:
    """Arrays of the words of each line; a long line gives overlapping pieces."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (how.piece - how.step)), F.lit(how.step))
        return F.when(F.size(words) <= how.piece, F.array(words)).otherwise(F.transform(starts, lambda i: F.slice(words, i, how.piece)))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lower_words)
    return F.flatten(F.transform(F.filter(lines, lambda w: F.size(w) > 0), cut))


def word_pairs(words: Column) -> Column:
    n = F.size(words) - 1
    return F.when(n < 1, words).otherwise(F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))))


def templates(spark) -> DataFrame:
    """family and words of every template."""
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in TEMPLATES))
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.family", lower_words(F.col("t.text")).alias("words"))


#: Marks of how many words a paragraph has besides those of the templates: 1 or more, 2, 4 and so on. No word has a space in front.
OTHERS = [f" {1 << i}" for i in range(7)]


@dataclass(frozen=True)
class Known:
    """Each template's family and word pairs, and the words and pairs of all templates."""

    templates: list[tuple[str, list[str]]]
    words: list[str]
    pairs: list[str]

    @classmethod
    def of(cls, spark) -> Known:
        rows = templates(spark).select("family", "words", word_pairs(F.col("words")).alias("pairs")).collect()
        every = lambda c: sorted({x for r in rows for x in r[c]})
        return cls([(r["family"], r["pairs"]) for r in rows], every("words"), every("pairs"))

    def features(self) -> list[str]:
        return sorted({*self.words, *self.pairs}) + OTHERS

    def grams(self, words: Column) -> Column:
        """The templates' words and pairs among ``words``, each once, in order, and the marks of how many words are not among them."""
        own = F.filter(words, lambda w: w.isin(self.words))
        n = F.greatest(F.size(words) - 1, F.lit(0))
        pair = lambda a, b: F.when(a.isin(self.words) & b.isin(self.words), F.concat_ws(" ", a, b))
        pairs = F.filter(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), pair), lambda p: p.isin(self.pairs))
        others = F.size(words) - F.size(own)
        marks = F.slice(F.array(*map(F.lit, OTHERS)), F.lit(1), F.when(others > 0, F.length(F.bin(others))).otherwise(0))
        return F.concat(F.sort_array(F.array_distinct(F.concat(own, pairs))), marks)

    def closeness(self, grams: Column) -> Column:
        """For each template, its family and the share of its word pairs that ``grams`` hold, best first."""
        shares = [F.struct((-F.size(F.array_intersect(grams, F.array(*map(F.lit, own)))) / F.lit(float(len(own)))).alias("less"), F.lit(-len(own)).alias("size"), F.lit(family).alias("family")) for family, own in self.templates]
        return F.array_sort(F.array(*shares))


def near_blocks(docs: DataFrame, how: Settings) -> DataFrame:
    """doc_id, words and pairs of every block of lines that may hold a notice, and the templates ``near`` to it.

    A place holds no more of a template's pairs than its whole block does, so only the templates of which the block
    holds enough are near. Blocks without any of the pairs of
    which every match holds one are left out before, and before that texts without the longer word of any such pair, so
    that most texts are read once by one pattern and not cut into words.
    """
    known = [(r["words"], r["pairs"]) for r in templates(docs.sparkSession).select("words", word_pairs(F.col("words")).alias("pairs")).collect()]
    texts = lambda xs: F.array(*map(F.lit, xs))
    own = F.array(*(F.struct(texts(pairs).alias("pairs"), F.lit(len(words) * 3 // 2 + 4).alias("reach")) for words, pairs in known))
    spare = lambda n: n - math.ceil(how.shared * n)  # noqa: E731  pairs that a match may lack
    keys = sorted({p for _, pairs in known for p in sorted(pairs, key=lambda x: (-len(x), x))[: spare(len(pairs)) + 1]})

    # A word has no letter or digit beside it; letters of either case, as texts are lowered only later.
    telling = sorted({max(k.split(" "), key=len) for k in keys})
    spelt = "|".join(w.replace(".", "[.]").replace("+", "[+]") for w in telling)
    first = "".join(sorted({w[0] for w in telling}))
    docs = docs.where(F.col("text").rlike(f"(?iu)(?<![\\p{{L}}\\p{{N}}])(?=[{first}])(?:{spelt})(?![\\p{{L}}\\p{{N}}])"))
    bare = lambda b: F.regexp_replace(b, "\n[^\\p{L}\\p{N}]+", "\n")  # noqa: E731  lines without comment marks
    block = F.split(F.coalesce("text", F.lit("")), "\n[^\\p{L}\\p{N}]*\n")
    words = docs.select("doc_id", F.explode(F.transform(block, lambda b: lower_words(bare(b)))).alias("words")).where(F.size("words") > 1)
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    # Behind an explode, pairs are built once and not again for every use.
    some = words.select("doc_id", F.explode(F.array(F.struct("words", pairs.alias("pairs")))).alias("b")).select("doc_id", "b.words", "b.pairs").where(F.arrays_overlap("pairs", texts(keys)))
    near = F.filter(own, lambda t: F.size(F.array_intersect("pairs", t["pairs"])) / F.size(t["pairs"]) >= how.shared)
    return some.select("doc_id", "words", "pairs", F.explode(F.array(near)).alias("near")).where(F.size("near") > 0)


def places(docs: DataFrame, how: Settings) -> DataFrame:
    """doc_id and words of every place that holds enough of a template's word pairs, wherever lines break.

    The places of a block of lines do not overlap; the best come first.
    """
    some = near_blocks(docs, how)

    def found(t: Column) -> Column:
        at = lambda i: F.array_contains(t["pairs"], F.try_element_at("pairs", i))
        held = lambda i: F.array_intersect(F.slice("pairs", i, t["reach"]), t["pairs"])
        share = lambda i: F.size(held(i)) / F.size(t["pairs"])
        last = lambda i: i + F.array_max(F.transform(held(i), lambda p: F.array_position(F.slice("pairs", i, t["reach"]), p))).cast("int")
        match = lambda i: F.struct((-share(i)).alias("less"), (-F.size(t["pairs"])).alias("size"), (last(i) - i).alias("length"), i.alias("first"), last(i).alias("last"))
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("pairs"), F.lit(1))), at), match)

    hits = F.array_sort(F.filter(F.flatten(F.transform("near", found)), lambda x: x["less"] <= -how.shared))
    none = F.array().cast("array<struct<less:double,size:int,length:int,first:int,last:int>>")
    apart = lambda kept, x: F.when(F.exists(kept, lambda k: (x["first"] <= k["last"]) & (k["first"] <= x["last"])), kept).otherwise(F.concat(kept, F.array(x)))
    some = some.withColumn("hits", F.aggregate(hits, none, apart)).select("doc_id", "words", F.explode("hits").alias("hit"))
    return some.select("doc_id", F.slice("words", F.col("hit.first"), F.col("hit.length") + 1).alias("words"))


def paragraphs(docs: DataFrame, how: Settings) -> DataFrame:
    """Labelled paragraphs: label, words, weight, fold (0 to 4; 0 is held out). Labels count the families; 0 is the documents' text.

    Equal paragraphs share a fold.
    """
    spark = docs.sparkSession
    families = sorted({f for f, _ in TEMPLATES})
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double")
    copies = templates(spark).select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(how.variants - 1))).alias("v"))
    lose = F.filter("words", lambda w, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(w, i, F.col("v")), F.lit(100)) >= F.col("v") % 5 * 5))
    notices = copies.select(label.alias("label"), lose.alias("words"), (F.col("v") % 5).cast("int").alias("fold")).where(F.size("words") > 0)
    # Stop words alone, and single words of notices, are other text too.
    single = templates(spark).select(F.explode("words").alias("w")).distinct().select(F.lit(0.0).alias("label"), F.array("w").alias("words"), F.lit(1).alias("fold"))
    # An outer explode, as a plain one cuts the texts once more to leave out those without a paragraph.
    other = docs.select(F.explode_outer(pieces(F.col("text"), how)).alias("words")).where(F.col("words").isNotNull())
    other = other.select(F.lit(0.0).alias("label"), "words", F.pmod(F.xxhash64("words"), F.lit(5)).cast("int").alias("fold"))
    return notices.unionByName(single).coalesce(1).unionByName(other).withColumn("weight", F.lit(1.0))


def weighed(rows: DataFrame, by: str, known: Known) -> DataFrame:
    """``rows`` (label, words, grams, weight, fold) once for each label, ``by`` and fold, by their weight; a notice isn't other text."""
    once = rows.groupBy("label", by, "fold").agg(F.sum("weight").alias("weight"), *([] if by == "grams" else [F.any_value("grams").alias("grams")]))
    # Naming the weight keeps this behind the grouping: templates are compared once for each row.
    apart = F.when(F.col("weight") > 0, (F.col("label") > 0) | (F.element_at(known.closeness(F.col("grams")), 1)["less"] > -0.5))
    return once.where(apart)


def examples(docs: DataFrame, how: Settings) -> DataFrame:
    """What is learned, spelt out: label, words, weight, fold, grams, with repeated paragraphs once."""
    known = Known.of(docs.sparkSession)
    return weighed(paragraphs(docs, how).withColumn("grams", known.grams(F.col("words"))), "words", known)


@dataclass
class Classifier:
    """The fitted stages, the families in label order, and the least probability of a notice."""

    model: PipelineModel
    families: list[str]
    least: float
    known: Known

    def judge(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) and ``family``: a family, ``unknown``, or null for other text."""
        how = Settings()
        found = self.model.transform(rows.withColumn("grams", self.known.grams(F.col("words")))).withColumn("p", vector_to_array("probability"))
        notice = 1.0 - F.element_at("p", 1) >= self.least
        # Only probable notices are compared with the templates.
        close = F.filter(self.known.closeness(F.col("grams")), lambda x: x["less"] <= -how.shared)
        # The classifier's most probable family of those that a template confirms; none confirmed is a licence of no known family.
        own = F.array(*map(F.lit, self.families))
        chance = lambda f: F.element_at("p", F.array_position(own, f).cast("int") + 1)
        likely = F.array_sort(F.transform(F.array_distinct(F.transform(close, lambda x: x["family"])), lambda f: F.struct((-chance(f)).alias("less"), f.alias("family"))))
        family = F.when(F.size(likely) > 0, F.get(likely, 0)["family"]).otherwise(F.lit("unknown"))
        return found.withColumn("family", F.when(notice, family)).drop("p", "grams", "counted", "features", "rawPrediction", "probability", "prediction")


def train(docs: DataFrame, how: Settings = Settings()) -> Classifier:
    """Fits on the templates' variants and the paragraphs of all documents, in one row for all that have the same features."""
    known = Known.of(docs.sparkSession)
    rows = paragraphs(docs, how).select("label", "weight", "fold", known.grams(F.col("words")).alias("grams"))
    rows = weighed(rows, "grams", known).cache()
    stages = [
        CountVectorizerModel.from_vocabulary(known.features(), inputCol="grams", outputCol="counted", binary=True),
        Normalizer(inputCol="counted", outputCol="features"),
        LogisticRegression(maxIter=40, regParam=2e-4, standardization=False, family="multinomial", weightCol="weight"),
    ]
    try:
        model = Pipeline(stages=stages).fit(rows.where("fold > 0"))
        held = model.transform(rows.where("fold = 0 AND label = 0")).groupBy(F.round(1.0 - F.element_at(vector_to_array("probability"), 1), 5).alias("p")).agg(F.sum("weight").cast("long").alias("n"))
        least = held.agg(F.percentile("p", F.lit(1.0 - how.false_rate), F.col("n"))).first()[0]
    finally:
        rows.unpersist()
    return Classifier(model, sorted({f for f, _ in TEMPLATES}), min(0.95, max(0.5, least or 0.0)), known)


def scan(docs: DataFrame, classifier: Classifier, how: Settings = Settings()) -> DataFrame:
    """doc_id, families, n_licence, n_unknown and n_pieces of every id in ``docs``.

    ``families`` are the confirmed ones, sorted and joined by commas. ``n_licence`` counts their places, or
    their pieces where those are more. Null and empty texts have no pieces.
    Rows that repeat an id, or lack one, are one document. Other columns play no part.
    """
    rows = docs.select("doc_id", F.explode_outer(pieces(F.col("text"), how)).alias("found"))
    words = F.coalesce("found", F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.col("found").isNotNull().alias("real"), F.lit(False).alias("placed"), words.alias("words"))
    rows = rows.unionByName(places(docs, how).select("doc_id", F.lit(False).alias("real"), F.lit(True).alias("placed"), "words"))
    judged = classifier.judge(rows)
    known = F.when((F.col("real") | F.col("placed")) & (F.col("family") != "unknown"), F.col("family"))
    return judged.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(known)), ",").alias("families"),
        F.greatest(F.count(F.when(F.col("real"), known)), F.count(F.when(F.col("placed"), known))).alias("n_licence"),
        F.count_if(F.col("real") & (F.col("family") == "unknown")).alias("n_unknown"),
        F.count_if("real").alias("n_pieces"),
    )


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    docs = documents(spark, sf_dir)
    return scan(docs, train(docs))
