"""Language identification by rank-order profiles of character n-grams.

A profile is the ``TOP`` most frequent n-grams of one to three letters (a word's edge counts as a letter),
by count and then by n-gram. A text's own profile is compared with every language's: the out-of-place
distance sums how far each of the text's n-grams stands from its place in the language's profile, and
``TOP`` for one that isn't in it. The nearest language is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents

TOP = 300
#: n-grams that a task counts before it hands on their sums.
HELD = 2_000_000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """All n-grams of a text's lower-case words, each packed into 64 bits: 21 for a letter, 1 for an edge."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = letters()[points]
    keep = own.copy()
    keep[1:] |= own[:-1]  # the first other character after a word is its edge
    line = np.where(own, points, 0)[keep].astype(np.int64) + 1
    if not own.any():
        return np.zeros(0, np.int64)
    line = np.concatenate([[1], line, [1]] if line[-1] != 1 else [[1], line])
    one = line[line > 1]
    two = (line[:-1] << 21) | line[1:]
    three = ((line[:-2] << 42) | two[1:])[line[1:-1] > 1]
    return np.concatenate([one, two, three])


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` keys (given ascending) by count, then by key."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``labelled`` (lang, text): summed in each task before they are shuffled."""

    def flush(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        langs, keys, counts = [], [], []
        for lang, parts in held.items():
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(k)
            keys.append(k)
            counts.append(c)
        arrays = [pa.array(langs, pa.string()), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (keys, counts))]
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                found = grams(text.as_py())
                held.setdefault(lang.as_py(), []).append(found)
                size += len(found)
                if size > HELD:
                    yield flush(held)
                    size = 0
        if held:
            yield flush(held)

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Profiles:
    """Every language's places of the n-grams that some profile holds; ``top`` where it is missing."""

    langs: list[str]
    keys: np.ndarray
    places: np.ndarray  # n-gram x language
    top: int

    def predict(self, text: str) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.langs:
            return "und", 0.0
        mine = ranked(*np.unique(found, return_counts=True), self.top)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        have = self.keys[at] == mine
        theirs = self.places[at[have]]
        away = np.where(theirs < self.top, np.abs(theirs - np.flatnonzero(have)[:, None]), self.top).sum(axis=0) + self.top * int((~have).sum())
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.top * len(mine))


def train(labelled: DataFrame, top: int = TOP) -> Profiles:
    """Profiles of all languages of ``labelled``; rows without text or language are left out.

    What reaches the driver is ``top`` rows for each language.
    """
    counts = gram_counts(labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place - 1).where(F.col("place") < top).select("lang", "gram", "place").toPandas()
    langs, keys = sorted(set(rows["lang"])), np.unique(rows["gram"].to_numpy(np.int64))
    places = np.full((len(keys), len(langs)), top, np.int64)
    places[np.searchsorted(keys, rows["gram"]), np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object))] = rows["place"]
    return Profiles(langs, keys, places, top)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (1: the same places, 0: nothing shared).

    A null text, or one without a letter, is ``und`` with score 0, as is everything if nothing was learned.
    Languages at equal distance go by name; repeated rows get equal answers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.predict(x.as_py() or "") for x in batch.column("text")]
            arrays = [batch.column("row"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "text")
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learned from those that aren't held out."""
    docs = documents(spark, sf_dir)
    profiles = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, profiles, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
