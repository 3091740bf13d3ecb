"""Lexical search: name tiers, inverted index, relevance, spelling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import deletions


def tiers(names: DataFrame, text: str) -> DataFrame:
    """(node, tier, name): the best tier of each node. 0: equal; 1: begins with the text; 2: holds words that
    begin with all of its words. ``names``: node, name (normalised)."""
    words = text.split()
    own = F.split("name", " ")
    all_words = F.lit(True)
    for w in words:
        all_words = all_words & F.exists(own, _begins(w))
    tier = F.when(F.col("name") == text, 0).when(F.col("name").startswith(text), 1).when(all_words, 2)
    found = names.withColumn("tier", tier).where("tier IS NOT NULL")
    best = Window.partitionBy("node").orderBy("tier", F.length("name"), "name")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("node", "tier", "name")


def _begins(word: str):
    return lambda x: x.startswith(word)


def postings(docs: DataFrame, id_: str, words: Column) -> DataFrame:
    """(id, word, tf) of every text."""
    return docs.select(F.col(id_).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))


def inverse_frequency(index: DataFrame, n: DataFrame) -> DataFrame:
    """(word, df, idf): ln(1 + (N - df + 1/2) / (df + 1/2)). ``n``: one row, ``n``."""
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def relevance(texts: DataFrame, asked: dict[str, float], k1: float = 1.2, b: float = 0.75, coverage: float = 0.45) -> DataFrame:
    """(id, score, matched) of texts that match enough terms. ``texts``: id, words; ``asked``: weights of the terms.

    A word counts once whatever its frequency, weighed by rarity and the text's length; a text must hold one
    of up to two terms, or ``coverage`` of more. Only the terms that are asked for leave a text's words; texts without a word
    count as texts, but not for the mean length.
    """
    size = F.size("words")
    whole = texts.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(size > 0, size)), F.lit(0.0)).alias("mean")).first()
    held = F.array_distinct(F.filter("words", lambda w: w.isin(*asked)))
    hits = texts.select("id", size.alias("length"), F.explode(held).alias("word"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))  # no more rows than terms
    idf = df.select("word", F.log(1 + (F.lit(whole["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.create_map(*(F.lit(x) for kv in asked.items() for x in kv))[F.col("word")]
    part = weight * F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("length") / F.lit(max(whole["mean"], 1.0))))
    need = 1 if len(asked) <= 2 else math.ceil(len(asked) * coverage)
    out = hits.join(F.broadcast(idf), "word").groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return out.where(F.col("matched") >= need).select("id", "score", "matched")


def corrections(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(asked, word, edits): the nearest known word of unknown words of four letters or more.

    One edit or swap is allowed up to seven letters, two from eight on. Words so near share what deletions of as
    many letters leave of them, and are joined by that; those that differ by more go. Fewer edits come first, then
    the lesser difference in length, then the word.
    """
    unknown = asked.join(vocabulary, asked["asked"] == vocabulary["word"], "left_anti").where(F.length("asked") >= 4)

    def near(words: DataFrame, least: int, most: int, edits: int) -> DataFrame:
        size = F.length("asked")
        left = words.where((size >= least) & (size <= most)).select("asked", F.explode(deletions(F.col("asked"), edits)).alias("key"))
        n = F.length("word")
        right = vocabulary.where((n >= least - edits) & (n <= most + edits)).select("word", F.explode(deletions(F.col("word"), edits)).alias("key"))
        pairs = left.join(right, "key").where(F.abs(F.length("asked") - F.length("word")) <= edits).select("asked", "word").distinct()
        return pairs.withColumn("edits", osa("asked", "word")).where(F.col("edits") <= edits)

    found = near(unknown, 4, 7, 1).unionByName(near(unknown, 8, 1 << 20, 2))
    best = Window.partitionBy("asked").orderBy("edits", F.abs(F.length("asked") - F.length("word")), "word")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("asked", "word", "edits")


@F.pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """Optimal string alignment distance: edits, and swaps of neighbours of which no letter is edited again.

    Pairs of the same two lengths go through the table of distances together, a cell at a time.
    """
    out = np.zeros(len(a), np.int32)
    sizes = pd.DataFrame({"a": a.str.len().to_numpy(), "b": b.str.len().to_numpy()})
    for (n, m), rows in sizes.groupby(["a", "b"]).indices.items():
        x, y = (np.frombuffer("".join(s.iloc[rows]).encode("utf-32-le"), "<u4").reshape(len(rows), k) for s, k in ((a, n), (b, m)))
        before, last = None, [np.full(len(rows), j, np.int32) for j in range(m + 1)]
        for i in range(1, n + 1):
            row = [np.full(len(rows), i, np.int32)]
            for j in range(1, m + 1):
                best = np.minimum(np.minimum(last[j], row[-1]) + 1, last[j - 1] + (x[:, i - 1] != y[:, j - 1]))
                if i > 1 and j > 1:
                    swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                    best = np.where(swapped, np.minimum(best, before[j - 2] + 1), best)
                row.append(best)
            before, last = last, row
        out[rows] = last[m]
    return pd.Series(out)
