"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a block of whole texts. Its words become symbols of the benchmark's alphabet; words that no
benchmark item has can't be in a match, so they only separate, and runs of other words that are shorter
than the shortest phrase are left out. Over what remains stands an FM-index: the Burrows-Wheeler transform
of the symbols in a wavelet matrix, whose ranks drive a backward search of all phrases at once, and suffix
positions sampled every ``SAMPLE`` symbols, from which the occurrences are located. Their words, merged,
are the removal spans of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, documents
from .textblocks import ALNUM, blocks

#: Words of a phrase; an item of fewer words is one phrase.
WINDOW = 13
SAMPLE = 8
#: Benchmark text searched in one pass, which a task holds with its phrases (about 100 bytes for each word). A
#: larger benchmark is searched in several passes, one after the other, each over all texts.
PASS_CHARS = 4 << 20
SHARD_BYTES = 4 << 20


class FMIndex:
    """An FM-index over symbols 1..top; the end symbol 0 is added."""

    def __init__(self, symbols: np.ndarray, top: int):
        text = np.append(symbols, 0).astype(np.int64)
        n = len(text)
        order = self._suffixes(text)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits, self.zeros = [], []
        self.depth = max(1, int(top).bit_length())
        self.last, part = last, last
        for level in reversed(range(self.depth)):
            bit = (part >> level) & 1
            self.bits.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            part = np.concatenate([part[bit == 0], part[bit == 1]])
        self.sampled = order % SAMPLE == 0
        self.sample_place = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.size = n

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling: ranks of 1, 2, 4, ... symbols until all differ."""
        n, width = len(text), 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        while True:
            second = np.zeros(n, np.int64)
            second[: max(n - width, 0)] = rank[width:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if n == 0 or step[-1] == n - 1:
                return order
            width *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(reversed(range(self.depth))):
            one, ones = ((symbol >> level) & 1).astype(bool), self.bits[i]
            low = np.where(one, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[i] + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``phrases`` that occur, with their ranges in suffix order. Phrases are right-aligned; 0 pads."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[which, j]
            step = symbol > 0
            first = self.before[symbol]
            low = np.where(step, first + self.rank(symbol, low), low)
            high = np.where(step, first + self.rank(symbol, high), high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows in suffix order: steps back to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            symbol = self.last[rows[walk]]
            rows[walk] = self.before[symbol] + self.rank(symbol, rows[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.samples[self.sample_place[rows]] + steps


@dataclass
class Phrases:
    """Distinct phrases of some benchmark items, as symbols, and the items that hold each."""

    alphabet: np.ndarray  # word hashes, ascending; a word's symbol is its place + 2, and 1 separates
    symbols: np.ndarray  # phrase x WINDOW, right-aligned
    sizes: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    shortest: int

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None], window: int = WINDOW) -> Phrases | None:
        rows, sizes, owners, row = [], [], [], 0
        for block in blocks(pa.array(texts, pa.string()), ALNUM, lower=True):
            for i in range(len(block.offsets) - 1):
                a, b = (int(x) for x in block.bounds[i : i + 2])
                n = min(window, b - a)
                if n:
                    found = np.zeros((b - a - n + 1, window), np.uint64)
                    found[:, window - n :] = np.lib.stride_tricks.sliding_window_view(block.hashes[a:b], n)
                    rows.append(found)
                    sizes.append(np.full(len(found), n))
                    owners.append(np.full(len(found), row))
                row += 1
        if not rows:
            return None
        words, size, owner = np.concatenate(rows), np.concatenate(sizes), np.concatenate(owners)
        used = np.arange(window) >= window - size[:, None]
        alphabet = np.unique(words[used])
        symbols = np.where(used, np.searchsorted(alphabet, words) + 2, 0).astype(np.int32)
        distinct, first, which = np.unique(symbols, axis=0, return_index=True, return_inverse=True)
        own = np.array([-1 if x is None else x for x in ids], np.int64)[owner]
        real = np.array([x is not None for x in ids])[owner]
        pairs = np.unique(np.stack([which.ravel()[real], own[real]]), axis=1)
        bounds = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
        return cls(alphabet, distinct, size[first], bounds.astype(np.int64), pairs[1], int(size.min()))


def _runs(keep: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last places of runs of kept words within one text, of ``least`` words or more."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = keep.copy(), keep.copy()
    opens[1:] &= ~keep[:-1]
    closes[:-1] &= ~keep[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(keep))]
    opens[cuts], closes[cuts - 1] = keep[cuts], keep[cuts - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = b - a >= least
    return a[long], b[long]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges start .. start + size, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


def search_block(block, phrases: Phrases) -> tuple[list, list]:
    """For each text of a block, its merged spans of hit words and the ids of items with an occurring phrase."""
    n = len(block.offsets) - 1
    spans: list[list] = [[] for _ in range(n)]
    items: list[list] = [[] for _ in range(n)]
    hashes = block.hashes
    place = np.minimum(np.searchsorted(phrases.alphabet, hashes), len(phrases.alphabet) - 1)
    known = phrases.alphabet[place] == hashes
    a, b = _runs(known, block.bounds, phrases.shortest)
    if not len(a):
        return spans, items
    words = _ranges(a, b - a)
    gaps = np.arange(len(a)).repeat(b - a)
    text = np.ones(len(words) + len(a), np.int64)
    text[np.arange(len(words)) + gaps] = place[words] + 2
    origin = np.zeros(len(text), np.int64)
    origin[np.arange(len(words)) + gaps] = words
    index = FMIndex(text, len(phrases.alphabet) + 1)
    # Only phrases whose first and last words stand in the shard can occur in it.
    here = np.zeros(len(phrases.alphabet) + 2, bool)
    here[text] = True
    some = np.flatnonzero(here[phrases.symbols[:, -1]] & here[phrases.symbols[np.arange(len(phrases.symbols)), phrases.symbols.shape[1] - phrases.sizes]])
    which, low, high = index.search(phrases.symbols[some].astype(np.int64))
    which = some[which]
    if not len(which):
        return spans, items
    at = origin[index.locate(_ranges(low, high - low))]
    phrase = np.repeat(which, high - low)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.sizes[phrase], -1)
    first, past = _runs(np.cumsum(cover[:-1]) > 0, block.bounds, 1)
    for doc, x, y in zip(np.searchsorted(block.bounds, first, "right") - 1, first, past):
        spans[doc].append({"start": int(x - block.bounds[doc]), "end": int(y - block.bounds[doc])})
    docs = np.searchsorted(block.bounds, at, "right") - 1
    size = phrases.item_bounds[phrase + 1] - phrases.item_bounds[phrase]
    pairs = np.unique(np.stack([np.repeat(docs, size), phrases.items[_ranges(phrases.item_bounds[phrase], size)]]), axis=1)
    for doc, item in pairs.T.tolist():
        items[doc].append(item)
    return spans, items


def passes(benchmark: DataFrame, window: int = WINDOW, pass_chars: int = PASS_CHARS) -> Iterator[Phrases]:
    """The benchmark's phrases, as many items at a time as ``pass_chars`` allows on average; one pass is held at a time."""
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // pass_chars))
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select(F.col("item_id").cast("long"), "text").collect()
        found = Phrases.of([r[0] for r in part], [r[1] for r in part], window)
        del part
        if found is not None:
            yield found
        del found  # before the next pass is read


FOUND = "array<struct<start:bigint,end:bigint>>"


def search(rows: DataFrame, phrases: Phrases | None, keep: str) -> tuple[DataFrame, object]:
    """``keep``, n_words, spans and items of ``rows`` (with ``text``) for the phrases of one pass, and their broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(phrases)
    # A scalar function: only texts go to Python and only findings come back, the rows stay where they are.
    @F.arrow_udf(f"struct<n_words:bigint,spans:{FOUND},items:array<bigint>>")
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        spans, items, n = [], [], []
        for block in blocks(texts, ALNUM, lower=True, most=SHARD_BYTES):
            s, i = search_block(block, sent.value) if sent.value is not None else ([[] for _ in block.offsets[1:]],) * 2
            spans += s
            items += i
            n += np.diff(block.bounds).tolist()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))], ["n_words", "spans", "items"])

    out = rows.select(keep, found("text").alias("_found"))
    return out.select(keep, "_found.n_words", "_found.spans", "_found.items"), sent


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, or all), n_words, spans and items of every row of ``docs``.

    Spans are merged, in words of the text, end exclusive. Null and empty texts have no words; null and
    empty items have no phrase; items that share an id count once, and an item without an id hits words but
    isn't listed. Other columns, whatever their names, stay inside ``doc``. Each row is judged by itself.

    A benchmark of one pass is searched in one go. Of a larger one, every pass writes what it hits, by text,
    before the next pass is read; the hits of all passes are then joined to the rows.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), "text")
    every = passes(benchmark, window, pass_chars)
    if benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] <= pass_chars:
        return search(rows, next(every, None), "doc")[0]
    scratch, hits = Scratch(docs.sparkSession, "op5"), []
    texts = docs.select(F.sha2("text", 256).alias("key"), "text")
    for phrases in every:  # no counter, which would hold on to the last pass
        found, sent = search(texts, phrases, "key")
        hits.append(scratch.write(found.where(F.size("spans") > 0).select("key", "spans", "items").dropDuplicates(["key"]), f"pass{len(hits)}"))
        sent.destroy()
        del phrases, found, sent
    if not hits:
        return search(rows, None, "doc")[0]
    union = hits[0]
    for h in hits[1:]:
        union = union.unionByName(h)
    merged = union.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast(FOUND)
    last = lambda s: F.element_at(s, -1)
    joined = lambda s, x: F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["start"].alias("start"), F.greatest(last(s)["end"], x["end"]).alias("end"))))
    step = lambda s, x: F.when((F.size(s) > 0) & (x["start"] <= F.get(s, F.size(s) - 1)["end"]), joined(s, x)).otherwise(F.concat(s, F.array(x)))
    merged = scratch.write(merged.select("key", F.aggregate("all", none, step).alias("spans"), "items"), "merged")
    counted = search(rows.withColumn("row", F.struct("doc", F.sha2("text", 256).alias("key"))), None, "row")[0]
    out = counted.select("row.doc", "row.key", "n_words").join(merged, "key", "left")
    return out.select("doc", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def contaminated() -> Column:
    """Some word is hit, and one in twenty at least."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns."""
    return find(docs, benchmark).where(~contaminated()).select("doc.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and occurring items of every document."""
    found = find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc.doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    p AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
    q AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM p),
    lengths AS (SELECT DISTINCT n FROM q),
    x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lengths WHERE len(w) >= n),
    y AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key FROM x),
    hits AS (SELECT doc_id, item_id, y.n, i FROM y JOIN q ON y.n = q.n AND y.key = q.key),
    h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
