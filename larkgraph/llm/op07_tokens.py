"""Token ids of every document in ORC files, in ascending order of document id.

Rows are ranged by id, encoded, and written as ORC: integer run-length encoding packs the ids, every
stripe carries row-index statistics and a Bloom filter on ``doc_id``, and files are split by stripe when
read. File names ascend with the ids, so a document's first token number is the sum of the files before
its own plus the documents before it in its file; both come from the ``n_tokens`` column alone.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents, small_batches
from .textblocks import LOWER, PLAIN, Block, KeyTable, blocks, byte_set


@dataclass(frozen=True)
class Encoding:
    """The tokenizer's vocabulary file, the id that ends a document, and the ORC layout."""

    vocabulary: str | None = None  # a path; null: word_bpe_49k.json of the public tokenizers
    end: int = 1
    stripe_bytes: int = 64 << 20
    index_rows: int = 1000
    rows_a_file: int = 0  # 0: as many files as shuffle partitions

    def path(self) -> str:
        if self.vocabulary:
            return self.vocabulary
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


#: Pieces whose ids a worker remembers, at about 60 bytes each.
REMEMBERED = 800_000

_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_DIGIT = byte_set((0x30, 0x39))
_MARK = byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # ASCII, but for the apostrophe


class Pieces(Block):
    """Texts cut where the tokenizer always cuts: at white space, around digits, between letters and ASCII marks.

    An apostrophe may begin a contraction, and other characters beyond ASCII may be of any kind, so nothing
    is cut next to those. Wholly ASCII pieces become lower case, as in the tokenizer's normaliser. The others
    keep their spelling: the normaliser composes before it lowers, and a capital may compose otherwise.
    """

    def __post_init__(self):
        starts, ends = self.spans
        wide = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(self.data >= 0x80, out=wide[1:])
        low = self.word_bytes[self.data]
        low[low] = np.repeat(wide[ends] == wide[starts], ends - starts)
        self.data = np.where(low, LOWER[self.data], self.data)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = super().spans
        letter, digit, mark = _LETTER[self.data], _DIGIT[self.data], _MARK[self.data]
        latin = np.zeros(len(letter), bool)  # first bytes of U+00C0 to U+00FF, but for the two signs among them
        latin[:-1] = (self.data[:-1] == 0xC3) & (self.data[1:] != 0x97) & (self.data[1:] != 0xB7)
        opens, closes = letter | latin, letter.copy()
        closes[1:] |= latin[:-1]
        cut = digit[:-1] | digit[1:] | (closes[:-1] & mark[1:]) | (mark[:-1] & opens[1:])
        inside = self.word_bytes[self.data]
        at = np.flatnonzero(cut & inside[:-1] & inside[1:]) + 1
        at = np.setdiff1d(at, starts, assume_unique=True)
        return np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))


def _spelling() -> dict[int, str]:
    """How byte-level vocabularies spell lower-case letters up to U+00FF: a character for each byte of UTF-8.

    Bytes that print in Latin-1 stand for themselves, the others are counted from U+0100 on.
    """
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    own = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    letters_ = [c for c in range(0x61, 0x100) if chr(c).isalpha() and chr(c).islower() and c not in (0xAA, 0xB5, 0xBA)]
    return {c: "".join(own[b] for b in chr(c).encode()) for c in letters_}


SPELLING = _spelling()
_PLAIN_PIECE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Encoder:
    """Encodes texts piece by piece; a worker sends each distinct piece through the tokenizer once.

    A piece of lower-case letters up to U+00FF is one word to normaliser and pre-tokenizer alike, so it goes
    to the model at once. Texts that hold the opening of a special token are encoded whole, and so are texts
    with a piece whose hash is that of a remembered one but whose second hash isn't.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.table = KeyTable(REMEMBERED)
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.checks = np.zeros(0, np.uint64)

    def _learn(self, block: Block, keys: np.ndarray, first: np.ndarray) -> None:
        """Adds pieces: their hashes and, for each, the place of one in the block."""
        raw, (starts, ends) = block.data.tobytes(), block.spans
        pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        found: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if _PLAIN_PIECE.fullmatch(piece):
                found[i] = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(SPELLING))]
            else:
                rest.append(i)
        for a in range(0, len(rest), 10_000):
            part = rest[a : a + 10_000]
            for i, coded in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)):
                found[i] = coded.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.fromiter((x for ids in found for x in ids), np.int32, int(size.sum()))
        self.table.add(keys)
        self.checks = np.concatenate([self.checks, block.checks[first]])
        self.at = np.concatenate([self.at, np.cumsum(size) - size + len(self.pool)])
        self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, pool])

    def _block(self, block: Block, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block's texts, one after the other, how many each has, and the texts whose ids are not to be trusted."""
        keys = block.hashes
        place = self.table.find(keys)
        lacking = np.flatnonzero(place < 0)
        if len(lacking):
            new, first = np.unique(keys[lacking], return_index=True)
            if len(self.at) + len(new) > REMEMBERED:
                self._forget()
                new, first = np.unique(keys, return_index=True)
                lacking = np.arange(len(keys))
            self._learn(block, new, lacking[first])
            place[lacking] = self.table.find(keys[lacking])
        unlike = np.flatnonzero(self.checks[place] != block.checks)
        size, at = self.size[place], self.at[place]
        run = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=run[1:])
        ends = run[block.bounds[1:]] + np.arange(1, len(block.bounds))
        out, keep = np.full(int(run[-1]) + len(ends), end, np.int32), np.ones(int(run[-1]) + len(ends), bool)
        keep[ends - 1] = False
        out[keep] = self.pool[np.repeat(at - run[:-1], size) + np.arange(run[-1])]
        return out, np.diff(ends, prepend=0), np.unique(np.searchsorted(block.bounds, unlike, "right") - 1)

    def texts(self, texts: pa.Array, end: int) -> pa.ListArray:
        """Ids of each text with ``end`` after them, as a list array; a null text is empty."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        parts, sizes = [], []
        plain = pc.if_else(special, pa.scalar("", texts.type), texts)
        whole = special.to_numpy(zero_copy_only=False).copy()
        for block in blocks(plain, PLAIN, most=1 << 20, kind=Pieces):
            ids, size, unlike = self._block(block, end)
            whole[block.first + unlike] = True
            parts.append(ids)
            sizes.append(size)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        if whole.any():
            own = np.split(ids, np.cumsum(size)[:-1])
            for i in np.flatnonzero(whole):
                own[i] = np.array([*self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, end], np.int32)
            ids, size = np.concatenate(own), np.array(list(map(len, own)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which outlives a task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(run, (run[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def encode(docs: DataFrame, how: Encoding) -> DataFrame:
    """doc_id, n_tokens and token_ids of every row, ranged and sorted by id (null ids first)."""
    path, end = how.path(), how.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = encoder.texts(part.column("text"), end)
                n = pc.cast(pc.list_value_length(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, ids], ["doc_id", "n_tokens", "token_ids"])

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(parts, "doc_id", F.xxhash64("text"))
    coded = ranged.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")
    return coded.sortWithinPartitions("doc_id", F.xxhash64("token_ids"))


def write_tokens(docs: DataFrame, path: str, how: Encoding = Encoding()) -> None:
    """Encodes ``docs`` and writes the ORC files below ``path``.

    Null and empty texts hold the end id alone. Rows that repeat an id follow each other, in an order that
    their tokens fix. Other columns are not written. An empty table writes files without rows.
    """
    small_batches(docs.sparkSession)
    writer = encode(docs, how).write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer = writer.option("orc.stripe.size", how.stripe_bytes).option("orc.row.index.stride", how.index_rows).option("orc.create.index", "true")
    (writer.option("maxRecordsPerFile", how.rows_a_file) if how.rows_a_file else writer).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The written columns; filters on ``doc_id`` prune stripes and row groups by index and Bloom filter."""
    return spark.read.schema("doc_id long, n_tokens long, token_ids array<int>").orc(path)


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the written files."""
    path = f"{Scratch(spark, 'op7').path}/tokens"
    write_tokens(documents(spark, sf_dir), path)
    return report(spark, path)


def report(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) from the files.

    The ids stay in the scan's tasks. Only one row for each file is summed in one place; within a file the
    running sum is over its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "doc_id", "n_tokens", "row")), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "row", "ids_crc32"])

    small_batches(spark)
    rows = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "n_tokens", F.xxhash64("token_ids").alias("row"), "token_ids")
    checked = rows.mapInArrow(run, "file string, doc_id long, n_tokens long, row long, ids_crc32 long")
    files = read_tokens(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("file_tokens"))
    before = files.select("file", (F.sum("file_tokens").over(Window.orderBy(F.length("file"), "file")) - F.col("file_tokens")).alias("before"))
    own = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = checked.join(before, "file").withColumn("start", F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")
