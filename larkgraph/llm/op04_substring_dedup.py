"""Duplicate passages by relative Lempel-Ziv parsing of every text against all earlier texts.

The reference is dealt into blocks by anchors: an anchor is the least hash among the 13 runs of 8 words in
a seed of 20 words, so equal seeds have equal anchors and meet in one block. Each block indexes every
seed once, by its first place (document, word): the reference is all text without its own repeats. So a match of
20 words or more has one place to start from, and the longest match from there, which the greedy parse takes, runs
as long as the next seeds are found at the next places of the same source. Where a factor ends, the next seed is
looked up by itself, so a seed that straddles two factors is judged like any other. The words of the factors,
all of 20 words or more, are the duplicate spans. As the index is a hash table of seeds dealt by key, a text's
look-ups are one join; a block is never searched for texts that share no anchor with it.

Texts of equal word sequences are one reference text; later ones are one factor from end to end. Seeds are
only made where their anchor occurs twice or more, as no other seed can be found again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents
from .textblocks import blocks, mix, signed

SEED = 20
GRAM = 8
#: An anchor that a task meets in so many texts is reported as frequent.
FREQUENT = 8
#: Frequent anchors, at most, whose seeds are looked up in two steps; which they are changes speed only.
SPLIT = 1 << 17
#: Parts into which the seeds of a frequent anchor are dealt first.
PARTS = 256
LAST_ID = (1 << 63) - 1


def anchors(grams: np.ndarray, seed: int = SEED, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every seed of a text, the least hash among its runs of ``gram`` words and its first place."""
    width = seed - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = view.argmin(axis=1) + np.arange(len(view))
    return grams[at], at


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple]:
    """(block, number of the text in the block, first word, past-last word) of each row."""
    for block in blocks(batch.column(column)):
        for i in range(len(block.offsets) - 1):
            yield block, i, int(block.bounds[i]), int(block.bounds[i + 1])


def _sequence_id(hashes: np.ndarray) -> int:
    """A 63-bit name of a word sequence."""
    spread = mix(hashes + mix(np.arange(1, len(hashes) + 1, dtype=np.uint64)))
    return int(mix(spread.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0] >> np.uint64(1))


class _Windows:
    """Window hashes of the block at hand, computed once for all its texts."""

    def __init__(self):
        self.block, self.grams, self.seeds = None, None, None

    def of(self, block, seeds: bool = False):
        if block is not self.block:
            self.block, self.grams, self.seeds = block, block.windows(GRAM), None
        if seeds and self.seeds is None:
            self.seeds = block.windows(SEED)
            run = np.append(np.uint64(0), np.cumsum(mix(block.hashes ^ np.uint64(0xA24BAED4963EE407))))
            self.checks = ((run[SEED:] - run[:-SEED])[: len(self.seeds)] >> np.uint64(33)).astype(np.int32)
        return self.grams, self.seeds


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: (id, n, text_id, sha) of a text, sha of all its words. kind 1: a frequent anchor and how many texts of a task hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "text_id", "sha", "text_hash"]
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        windows, size = _Windows(), 0

        def frequent() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(pending), return_counts=True)
            keys, n = signed(keys[n >= FREQUENT]), n[n >= FREQUENT]
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys), pa.array(n), pa.array(np.zeros(len(keys), np.int64)), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int64())], names)

        for batch in batches:
            sizes, ids, shas = [], [], []
            for block, _, a, b in _texts(batch):
                name = _sequence_id(block.hashes[a:b])
                sizes.append(b - a)
                ids.append(name)
                starts, ends = block.spans
                words = block.data[starts[a] : ends[b - 1]].tobytes().split() if b > a else []
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if b - a >= SEED and name not in seen:
                    seen.add(name)
                    grams, _ = windows.of(block)
                    pending.append(np.unique(anchors(grams[a : b - GRAM + 1])[0]))
                    size += len(pending[-1])
            if size > 2_000_000:
                yield frequent()
                size = 0
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(shas, pa.string()), batch.column("text_hash")], names)
        if pending:
            yield frequent()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "kind int, id long, n long, text_id long, sha string, text_hash long")


def anchor_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(anchor, text_id, twice, frequent): the distinct anchors of every text, each text once in a task."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        windows = _Windows()
        for batch in batches:
            keys, names, twice = [], [], []
            for block, _, a, b in _texts(batch):
                if b - a < SEED or (name := _sequence_id(block.hashes[a:b])) in seen:
                    continue
                seen.add(name)
                grams = windows.of(block)[0][a : b - GRAM + 1]
                found, n = np.unique(grams[np.unique(anchors(grams)[1])], return_counts=True)
                keys.append(found)
                names.append(np.full(len(found), name, np.int64))
                twice.append(n > 1)
            if len(seen) > 1_000_000:
                seen.clear()
            if keys:
                key = np.concatenate(keys)
                late = sent.value
                often = late[np.minimum(np.searchsorted(late, key), len(late) - 1)] == key if len(late) else np.zeros(len(key), bool)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.concatenate(names)), pa.array(np.concatenate(twice)), pa.array(often)], ["anchor", "text_id", "twice", "frequent"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "anchor long, text_id long, twice boolean, frequent boolean")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(text_id, frequent, anchors): the anchors of each text that occur twice or more, in it or in another.

    Frequent anchors are known to and are dealt in parts; the others, few in any task, are dealt by anchor and
    counted.
    """
    part = F.when(F.col("frequent"), F.pmod(F.xxhash64("text_id"), F.lit(PARTS))).otherwise(F.lit(0))
    dealt = rows.withColumn("part", part).repartition("anchor", "part").dropDuplicates(["anchor", "part", "text_id"])
    dealt = dealt.withColumn("texts", F.count("*").over(Window.partitionBy("anchor", "part"))).where("frequent OR twice OR texts > 1")
    return dealt.groupBy("text_id").agg(F.collect_list(F.when(~F.col("frequent"), F.col("anchor"))).alias("rare"), F.collect_list(F.when(F.col("frequent"), F.col("anchor"))).alias("often"))


def seeds(texts: DataFrame) -> DataFrame:
    """(seed, place, id, text_id, frequent): the seeds of ``texts`` (id, text_id, text, rare, often) whose anchor is listed.

    ``seed`` is a hash of the words in order. ``place`` holds the seed's first word and, in its upper half, a
    check that comes from a sum over the words.
    """
    names = ["seed", "place", "id", "text_id", "frequent"]

    def listed(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
        return np.sort(np.asarray(batch.column(column)[row].values, np.int64)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, (block, _, a, b) in enumerate(_texts(batch)):
                if b - a < SEED or _sequence_id(block.hashes[a:b]) != batch.column("text_id")[row].as_py():
                    continue
                grams, whole = windows.of(block, seeds=True)
                key = signed(anchors(grams[a : b - GRAM + 1])[0])
                rare, often = (np.isin(key, listed(batch, c, row)) for c in ("rare", "often"))
                at = np.flatnonzero(rare | often)
                out[0].append(signed(whole[a + at]))
                out[1].append((windows.checks[a + at].astype(np.int64) << 32) | at)
                out[2].append(np.full(len(at), batch.column("id")[row].as_py(), np.int64))
                out[3].append(np.full(len(at), batch.column("text_id")[row].as_py(), np.int64))
                out[4].append(often[at])
                if sum(map(len, out[0])) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                    out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    return texts.select("id", "text_id", F.col("text").cast("binary").alias("text"), "rare", "often").mapInArrow(run, "seed long, place long, id long, text_id long, frequent boolean")


def look_up(rows: DataFrame) -> DataFrame:
    """(id, text_id, at, source, source_at) of every seed that starts earlier too.

    The source is the first place of the seed, or for seeds of frequent anchors an earlier one: those are
    dealt in ``PARTS`` by document, where all but a part's first are found at once, and the parts' firsts
    are then looked up among each other.
    """
    columns = ["id", "text_id", "at", "source", "source_at"]

    def found(part: DataFrame, *keys: str) -> DataFrame:
        own = Window.partitionBy(*keys).orderBy("id", "text_id", "at")
        # A count, as Spark would limit the groups of a row number in one branch, which then shares no exchange with the other.
        nth = F.count("*").over(own.rowsBetween(Window.unboundedPreceding, 0))
        return part.withColumns({"nth": nth, "source": F.first("id").over(own), "source_at": F.first("at").over(own)})

    part = F.when(F.col("frequent"), F.pmod(F.xxhash64("id", "text_id"), F.lit(PARTS))).otherwise(F.lit(0))
    # Dealt by seed and part, so that the check costs no further exchange; it stands beside the place until then.
    dealt = rows.withColumn("part", part).repartition("seed", "part")
    dealt = dealt.withColumns({"check": F.shiftright("place", 32), "at": F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")}).drop("place")
    once = found(dealt, "seed", "check", "part")
    firsts = once.where("frequent AND nth = 1").select("seed", "check", "id", "text_id", "at")
    # Both branches name the same columns, so that they read one exchange of the seeds.
    return once.where("nth > 1 AND frequent IS NOT NULL").select(columns).unionByName(found(firsts, "seed", "check").where("nth > 1").select(columns))


def parse(at: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of a text from its found seeds in order: first seed of each, and its words."""
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(source_at) != 1)
    first = np.flatnonzero(new)
    return first, at[np.append(first[1:], len(at)) - 1] - at[first] + SEED


FACTORS = "array<struct<start:long,size:long,source:long,source_start:long>>"


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "size", "source", "source_start")]))
    for batch in batches:
        removed, shas, factors, row = [], [], [], 0
        for block, _, a, b in _texts(batch):
            hits = batch.column("hits")[row]
            row += 1
            found = hits.values if hits.is_valid else None
            n = len(found) if found is not None else 0
            at, source, source_at = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64) for c in ("at", "source", "source_at"))
            order = np.argsort(at)
            at, source, source_at = at[order], source[order], source_at[order]
            first, size = parse(at, source, source_at)
            gone = np.zeros(b - a + 1, np.int64)
            np.add.at(gone, at[first], 1)
            np.add.at(gone, at[first] + size, -1)
            gone = np.cumsum(gone[:-1]) > 0
            starts, ends = block.spans
            words = block.data[starts[a] : ends[b - 1]].tobytes().split() if b > a else []
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone) if not g])).hexdigest())
            factors.append([{"start": int(at[f]), "size": int(s), "source": int(source[f]), "source_start": int(source_at[f])} for f, s in zip(first, size)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_id"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(factors, kind)], ["id", "text_id", "n_removed", "kept_sha256", "factors"])


def duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and factors of every row of ``docs``.

    A factor (start, size, source, source_start) repeats ``size`` words of the document ``source``. Null and
    empty texts have no words. Rows that repeat an id and a text are one document and share its result; rows
    that repeat an id with other texts are documents of their own, in an order their words fix; rows without
    an id come last. Other columns play no part, and an empty table gives no rows.
    """
    found = scratch.write(describe(docs), "found")
    own = found.where("kind = 0").select(F.coalesce("id", F.lit(LAST_ID)).alias("id"), F.col("id").alias("doc_id"), "n", "text_id", "sha", "text_hash")
    top = found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(SPLIT)
    frequent = np.sort(np.array([r[0] for r in top.select("id").collect()], np.int64).view(np.uint64))
    repeated = scratch.write(repeated_anchors(anchor_rows(docs, frequent)), "anchors")
    scratch.release()

    # A copy has the digest of its words in common with the first text, not only a name; written, so that a group of copies can be split.
    first = scratch.write(own.groupBy("text_id", "sha").agg(F.min(F.struct("id", "text_hash")).alias("f")).select("text_id", "sha", "f.*"), "first")
    wanted = first.join(repeated, "text_id").select(F.col("id").alias("wanted"), "text_id", F.col("text_hash").alias("spelling"), "rare", "often")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")
    texts = texts.join(wanted, (F.col("id") == F.col("wanted")) & (F.xxhash64("text") == F.col("spelling"))).drop("wanted", "spelling")
    texts = texts.dropDuplicates(["id", "text_id"])  # rows that repeat an id and a text
    texts = scratch.write(texts, "texts")
    scratch.remove("anchors")
    scratch.release()
    hits = look_up(seeds(texts))
    hits = hits.groupBy("id", "text_id").agg(F.collect_list(F.struct("at", "source", "source_at")).alias("hits"))
    hits = scratch.write(hits, "hits")
    scratch.release()
    parsed = texts.select("id", "text_id", F.col("text").cast("binary").alias("text")).join(hits, ["id", "text_id"])
    parsed = parsed.mapInArrow(_factor, f"id long, text_id long, n_removed long, kept_sha256 string, factors {FACTORS}")
    parsed = scratch.write(parsed, "parsed")

    rows = own.join(first.select("text_id", "sha", F.col("id").alias("first_id")), ["text_id", "sha"]).join(parsed, ["id", "text_id"], "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n") >= SEED)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("size"), F.col("first_id").alias("source"), F.lit(0).cast("long").alias("source_start")))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("factors", F.array().cast(FACTORS.replace("long", "bigint")))).alias("factors"),
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept words of every document."""
    return duplicates(documents(spark, sf_dir), Scratch(spark, "op4")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
    WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS place FROM x),
    c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE place > 1),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
    k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept FROM u ANTI JOIN c ON c.doc_id = u.doc_id AND c.k = u.k GROUP BY u.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
