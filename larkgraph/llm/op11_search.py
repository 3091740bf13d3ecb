"""Ranked lexical search over an index of document shards with integer impacts.

A shard is a block of whole texts. Its postings are compressed sparse rows: ascending term hashes, where each term's
postings begin, and for every posting the document's place in the shard and its impact, the part of the score
that term frequency and length decide. Impacts need only the corpus's counts of documents and terms, so they are worked out
once and stay right for every query; a term's weight, which its document frequency decides, is
multiplied in by the search.

A search goes through a shard term by term and adds into a dense array of its documents' scores, one for each item.
The best of a shard are cut at the k-th score by argpartition; ties there are decided by id. Shards of a task are
merged on the way, tasks by a window for each item. Every document is in the index and every item is held against
all of them. Items come in passes of a bounded number of terms; each pass reads the written index again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents
from .textblocks import ALNUM, blocks, signed

#: Best documents of an item.
MOST = 10
#: Text of a shard; a longer text is a shard by itself.
SHARD_BYTES = 8 << 20
#: Terms of items that are searched in one pass, on average; a task holds them (about 50 bytes each).
PASS_TERMS = 1 << 20
#: Weights of a document's own length and of the average one, in hundredths.
OWN, FLAT = 75, 25
INDEX = "docs array<long>, terms binary, starts binary, places binary, impacts binary"
FOUND = "item int, doc_id long, score long"


@dataclass
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int


def measure(docs: DataFrame) -> Corpus:
    """Counts of ``docs``; one row a batch is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(b.bounds) for b in blocks(batch.column(0), ALNUM, lower=True)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["documents", "terms"])

    total = docs.select("text").mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Corpus(total[0] or 0, total[1] or 0)


def impact(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``n`` terms count for, before the term's weight."""
    m = FLAT + (OWN * n * corpus.documents) // corpus.terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(hashes: np.ndarray, bounds: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts, places, impacts) of a shard whose text i has the terms bounds[i] to bounds[i + 1]."""
    n = np.diff(bounds)
    place = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(hashes, kind="stable")  # so that places ascend within a term
    h, place = hashes[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    posting = new.copy()
    posting[1:] |= place[1:] != place[:-1]
    first = np.flatnonzero(posting)
    tf = np.diff(np.append(first, len(h)))
    starts = np.append(np.flatnonzero(new[first]), len(first)).astype(np.int32)
    places = place[first]
    return h[new], starts, places, impact(tf, n[places], corpus).astype(np.int32)


def index(docs: DataFrame, corpus: Corpus, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row of compressed sparse postings for each shard of ``docs``."""
    names = ["docs", "terms", "starts", "places", "impacts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), ALNUM, lower=True, most=shard_bytes):
                ids = batch.column("doc_id").slice(block.first, len(block.offsets) - 1)
                parts = postings(block.hashes, block.bounds, corpus)
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def asked(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts) of every item: its distinct terms and how often each stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for block in blocks(batch.column("text"), ALNUM, lower=True):
                for a, b in zip(block.bounds[:-1], block.bounds[1:]):
                    key, n = np.unique(block.hashes[a:b], return_counts=True)
                    terms.append(signed(key))
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["item_id", "terms", "counts"])

    once = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    return once.mapInArrow(run, "item_id long, terms array<long>, counts array<long>").where(F.size("terms") > 0)


def frequencies(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the ascending ``terms`` occurs; each task sends one row for each that it met."""
    sent = shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at, start, end = _lookup(sent.value, batch, row)
                df[at] += end - start
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(df[seen])], ["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in shards.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r[0]] = r[1]
    sent.destroy()
    return out


def _lookup(terms: np.ndarray, batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the ascending ``terms`` a shard holds, and where their postings begin and end."""
    own = np.frombuffer(batch.column("terms")[row].as_buffer(), np.uint64)
    starts = np.frombuffer(batch.column("starts")[row].as_buffer(), np.int32)
    if not len(own):
        return (np.zeros(0, np.int64),) * 3
    place = np.minimum(np.searchsorted(own, terms), len(own) - 1)
    at = np.flatnonzero(own[place] == terms)
    return at, starts[place[at]].astype(np.int64), starts[place[at] + 1].astype(np.int64)


def weight(df: int, corpus: Corpus) -> int:
    return math.floor(1000 * math.log((2 * corpus.documents + 2) / (2 * df + 1)))


def best(score: np.ndarray, ids: np.ndarray, real: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores above 0, highest first; equal ones by id, those without an id last."""
    over = np.flatnonzero(score > 0)
    if len(over) > most:
        part = score[over]
        floor = part[np.argpartition(part, len(part) - most)[len(part) - most]]
        over = over[part >= floor]  # with all that tie there
    return over[np.lexsort((ids[over], ~real[over], -score[over]))][:most]


@dataclass
class Questions:
    """The items of one pass: ascending terms with their weights, and each item's terms and how often it has them."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]


def search(shards: DataFrame, questions: Questions, most: int = MOST) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item, by its number in ``questions``."""
    sent = shards.sparkSession.sparkContext.broadcast(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        kept = [none] * len(q.items)
        for batch in batches:
            for row in range(batch.num_rows):
                at, start, end = _lookup(q.terms, batch, row)
                where = np.full(len(q.terms), -1, np.int64)
                where[at] = np.arange(len(at))
                places = np.frombuffer(batch.column("places")[row].as_buffer(), np.int32)
                impacts = np.frombuffer(batch.column("impacts")[row].as_buffer(), np.int32)
                listed = batch.column("docs")[row].values
                real = np.asarray(listed.is_valid())
                ids = np.asarray(listed.fill_null(0), np.int64)
                for i, (terms, counts) in enumerate(q.items):
                    score = np.zeros(len(ids), np.int64)
                    for t, n in zip(terms, counts):
                        k = where[t]
                        if k >= 0:
                            part = slice(start[k], end[k])
                            score[places[part]] += int(q.weights[t] * n) * impacts[part].astype(np.int64)
                    top = best(score, ids, real, most)
                    if len(top):
                        s, d, r = (np.concatenate(x) for x in zip(kept[i], (score[top], ids[top], real[top])))
                        top = best(s, d, r, most)
                        kept[i] = s[top], d[top], r[top]
        sizes = [len(k[0]) for k in kept]
        s, d, r = (np.concatenate(x) for x in zip(none, *kept))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(kept), dtype=np.int32), sizes)), pa.array(d, mask=~r), pa.array(s)], ["item", "doc_id", "score"])

    return shards.mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, scratch: Scratch, most: int = MOST, shard_bytes: int = SHARD_BYTES, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``most`` best documents of every item, those with a score above 0.

    Null and empty texts have no terms: such documents are found by nothing and such items find nothing. Rows that share
    an id are documents of their own, and rows without an id stand behind equal scores that have one. Items that repeat an
    id and a text count once; items that share an id with other texts are ranked each for itself, and an
    item without an id is ranked under null. Other columns play no part; an empty table gives no rows.
    Terms are named by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    corpus = measure(docs)
    if not corpus.terms:
        return result
    shards = scratch.write(index(docs, corpus, shard_bytes), "index")
    wanted = scratch.write(asked(items), "items")
    n = max(1, -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // pass_terms))
    for k in range(n):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)) == k).collect() if n > 1 else wanted.collect()
        if not rows:
            continue
        own = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        terms = np.unique(np.concatenate(own))
        weights = np.array([weight(int(df), corpus) for df in frequencies(shards, terms)], np.int64)
        questions = Questions(terms, weights, [(np.searchsorted(terms, t), np.array(r["counts"], np.int64)) for t, r in zip(own, rows)])
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = search(shards, questions, most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        found = scratch.write(found.join(names, "item").select("item_id", "rank", "doc_id", "score"), f"found{k}")
        result = result.unionByName(found)
    return result


def op11_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op11"))


ORACLE = r"""
    WITH t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
    c AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
    w AS (SELECT term, floor(1000 * ln((2 * c.N + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, c.N),
    q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n.n * c.N) // c.L))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
