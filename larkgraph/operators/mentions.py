"""Phrases of a dictionary in running text: where they stand, which hold others, which are negated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import written

#: Words that deny what follows, and words that end their reach.
NEGATIONS = ("no", "not", "without", "kein", "keine", "keinen", "ohne", "sans")
BOUNDARIES = ("and", "but", "with", "und", "aber", "mit")
#: How many words back a denial is looked for.
REACH = 3
#: Letters of a phrase of one word, at least.
LEAST_LETTERS = 3


def mentions(texts: DataFrame, phrases: DataFrame, reach: int = REACH) -> DataFrame:
    """(id, start, n, phrase, context): every place where a phrase of the dictionary stands, whole words only.

    ``texts``: id, words (array); ``phrases``: phrase (words joined by a blank). ``start`` counts words from 0; ``context`` holds
    up to ``reach`` words before. A phrase that is the whole text is a name, not a mention; single words of
    under three letters are passed over. Words that begin no phrase are left out by a join on the word alone, so
    only places that can match are cut into windows of the sizes that phrases with that first word have. The
    dictionary is written first, so that its size is known: unless it is large it goes to the texts, and words stay where they are.
    """
    known = written(phrases.where((F.length("phrase") >= LEAST_LETTERS) | F.contains("phrase", F.lit(" "))).select("phrase").distinct())
    split = F.split("phrase", " ")
    first = written(known.groupBy(split[0].alias("word")).agg(F.collect_set(F.size(split)).alias("sizes")))
    longest = known.agg(F.max(F.size(split))).first()[0] or 0

    def window(w: Column, i: Column) -> Column:
        ahead = F.slice("words", i + 1, F.lit(longest))
        behind = F.slice("words", F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach)))
        return F.struct(w.alias("word"), i.alias("start"), ahead.alias("ahead"), behind.alias("context"))

    places = texts.select("id", F.size("words").alias("size"), F.explode_outer(F.transform("words", window)).alias("w")).select("id", "size", "w.*").where("word IS NOT NULL")
    cut = places.join(first, "word").select("id", "size", "start", "ahead", "context", F.explode("sizes").alias("n"))
    cut = cut.where((F.col("n") <= F.size("ahead")) & (F.col("n") < F.col("size"))).withColumn("phrase", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " "))
    return cut.join(known, "phrase").select("id", "start", "n", "phrase", "context")


def negated(context: Column) -> Column:
    """Whether a denial stands among the words before, with no conjunction in between."""
    return F.aggregate(context, F.lit(False), lambda s, w: F.when(w.isin(*BOUNDARIES), False).when(w.isin(*NEGATIONS), True).otherwise(s))


def longest(spans: DataFrame) -> DataFrame:
    """The spans (id, start, n) of each text that no longer one holds; overlaps stay, and so do rows of one span."""
    # Whatever begins before, or here and is longer, comes first; if one of them ends no earlier, it holds this span.
    place = F.shiftleft(F.col("start").cast("long"), 32) - F.col("n")
    before = Window.partitionBy("id").orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    reached = spans.withColumn("_place", place).withColumn("_reached", F.max(end).over(before))
    return reached.where(F.col("_reached").isNull() | (F.col("_reached") < end)).drop("_place", "_reached")


def profile(found: DataFrame, names: DataFrame, above: DataFrame) -> DataFrame:
    """(id, node, state): the ``present`` and ``excluded`` nodes of every text.

    ``found``: mentions; ``names``: phrase, node (of the kind that can be present); ``above``: node, ancestor, without the node
    itself. A denied mention excludes all nodes it may name; another counts where its phrase names one node only. What is
    excluded is not present, and of present nodes those that stand above another one are left out.
    """
    names = names.select("phrase", "node").distinct()
    single = names.groupBy("phrase").agg(F.count("*").alias("targets"))
    each = found.select("id", "phrase", negated(F.col("context")).alias("no")).distinct().join(names, "phrase").join(single, "phrase")
    state = each.groupBy("id", "node").agg(F.bool_or("no").alias("excluded"), F.bool_or(~F.col("no") & (F.col("targets") == 1)).alias("present"))
    present = state.where("present AND NOT excluded").select("id", "node")
    general = present.join(above, "node").select("id", F.col("ancestor").alias("node")).distinct()
    specific = present.join(general, ["id", "node"], "left_anti")
    return specific.withColumn("state", F.lit("present")).unionByName(state.where("excluded").select("id", "node", F.lit("excluded").alias("state")))
