"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered through their first 50 bytes only, and groups that are equal at that depth are the repeated
strings. Every pass drops suffixes that stand alone, so later digits are read for few of them.

The first digit deals the suffixes to tasks. It is the anchor of a suffix: of the 31 runs of 20 bytes
in its 50 bytes, the one of least hash, the leftmost of several, with its distance from the suffix. Equal
suffixes have equal anchors, and neighbouring suffixes mostly share one: a *stretch* of them
travels as one string of up to 80 bytes, not as up to 31 of 50. Blocks of text exchange the anchors' 32-bit names first
(one for 16 bytes of text), and only stretches whose anchor stands in two texts or more go on. In
the task of an anchor, equal stretches are one; where several differ, their suffixes are sorted by
the further digits of 8 bytes.

A block sends equal stretches once, so copies and hot passages grow with the blocks that hold them, not with
their occurrences. Anchors of ``FREQUENT`` texts or more are not left to a task: their suffixes are grouped one by
one, by a 128-bit hash of all 50 bytes, in an aggregate that combines on the map side and a join that can be split.
Equal texts go through all this once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, documents
from .textblocks import bytes_hash, mix, signed

#: Bytes of a string that is looked for, and of an anchor.
SIZE = 50
GRAM = 20
#: Longer texts are cut; a piece has the suffixes that start in so many bytes, and the bytes that they need.
PIECE = 1 << 20
BLOCK_BYTES = 1 << 21
#: Text whose anchors are sorted in one task.
BUCKET_BYTES = 16 << 20
#: Suffixes of a task that are sorted at a time, if no single anchor has more.
SORTED = 1 << 20
#: Anchors of so many texts have their suffixes dealt one by one. Speed only.
FREQUENT = 1 << 15
LAST_ID = (1 << 63) - 1
SPANS = "array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def make_blocks(texts: DataFrame, size: int = SIZE, piece: int = PIECE) -> DataFrame:
    """(block, ids, shas, ats, sizes, data): pieces of ``texts`` (id, sha, text), about ``BLOCK_BYTES`` a row."""
    names = ["ids", "shas", "ats", "sizes", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        total = 0

        def block() -> pa.RecordBatch:
            ids, shas, ats, parts = zip(*held)
            row = [pa.array([ids], pa.list_(pa.int64())), pa.array([shas], pa.list_(pa.binary())), pa.array([ats], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            for id_, sha, text in zip(batch.column("id").to_pylist(), batch.column("sha").to_pylist(), batch.column("text")):
                data = text.as_buffer()
                for at in range(0, max(1, len(data) - size + 1), piece):
                    held.append((id_, sha, at, data[at : at + piece + size - 1].to_pybytes()))
                    total += len(held[-1][3])
                    if total >= BLOCK_BYTES:
                        yield block()
                        total = 0
        if held:
            yield block()

    rows = texts.select("id", "sha", F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "ids array<long>, shas array<binary>, ats array<long>, sizes array<int>, data binary")
    return rows.withColumn("block", F.monotonically_increasing_id())


class Pieces:
    """The pieces of a block: their bytes, where each begins, and the id of each one's text."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids = np.asarray(batch.column("ids")[row].values, np.int64)
        self.data = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(np.asarray(batch.column("sizes")[row].values, np.int64))])

    def stretches(self, buckets: int, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
        """(piece, first, last, anchor, name) of the runs of suffixes that share an anchor.

        A name is the anchor's bucket and, below it, 32 bits of its hash.
        """
        n, width = len(self.data) - gram + 1, size - gram + 1
        if n < width:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        least = mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) ^ eight[gram - 8 : n + gram - 8] * np.uint64(0xD6E8FEB86659FD93))
        hashes, place, reach = least, np.arange(n, dtype=np.int32), 1
        while reach < width:  # the least of ``reach`` grams from each place on, the leftmost of equals
            step = min(reach, width - reach)
            right = least[step:] < least[:-step]
            place = np.where(right, place[step:], place[:-step])
            least = np.where(right, least[step:], least[:-step])
            reach += step
        piece = np.repeat(np.arange(len(self.ids)), np.diff(self.begin))[: len(place)]
        ok = np.arange(len(place)) + size <= self.begin[piece + 1]
        start = np.flatnonzero(ok)
        if not len(start):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        new = np.ones(len(start), bool)
        new[1:] = place[start[1:]] != place[start[:-1]]
        at = np.flatnonzero(new)
        first, last = start[at], start[np.append(at[1:], len(start)) - 1]
        anchor = place[first].astype(np.int64)
        key = hashes[anchor]
        name = ((key >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)
        return piece[first], first, last, anchor, name


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each range of ``values`` as one binary value."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and how many each entry holds."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def _shares(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of ascending names and where each begins, with the end."""
    bucket = (name >> np.uint64(32)).astype(np.int32)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[at], np.append(at, len(name))


def _anchors(piece: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct names, ascending, and how many of its pieces hold each."""
    order = np.argsort(name, kind="stable")
    n, p = name[order], piece[order]
    new = np.ones(len(n), bool)
    new[1:] = n[1:] != n[:-1]
    pair = new.copy()
    pair[1:] |= p[1:] != p[:-1]
    return n[new], np.add.reduceat(pair.astype(np.int64), np.flatnonzero(new)) if len(n) else np.zeros(0, np.int64)


def anchor_rows(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, names, texts): a block's distinct anchors of each bucket and how many texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                piece, _, _, _, name = Pieces(batch, row).stretches(buckets)
                name, texts = _anchors(piece, name)
                bucket, bounds = _shares(name)
                block = np.full(len(bucket), batch.column("block")[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(block), _cut((name & np.uint64(0xFFFFFFFF)).astype(np.uint32), bounds), _cut(np.minimum(texts, 65535).astype(np.uint16), bounds)], ["bucket", "block", "names", "texts"])

    return blocks.select("block", "ids", "sizes", "data").mapInArrow(run, "bucket int, block long, names binary, texts binary")


def repeated(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(bucket, block, codes): of a block's anchors in order, which stand in one text (0), in several (1), in very many (2)."""

    def judge(table: pa.Table) -> pa.Table:
        names, n = _flat(table.column("names"), np.uint32)
        texts, _ = _flat(table.column("texts"), np.uint16)
        _, which = np.unique(names, return_inverse=True)
        total = np.bincount(which, weights=texts)[which]
        codes = ((total > 1).astype(np.uint8) + (total >= frequent)).astype(np.uint8)
        bounds = np.append(0, np.cumsum(n))
        some = np.add.reduceat(codes.astype(np.int64), bounds[:-1]) > 0
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "codes": _cut(codes, bounds)}).filter(pa.array(some))

    return rows.groupBy("bucket").applyInArrow(judge, "bucket int, block long, codes binary")


def _distinct(key: np.ndarray, check: np.ndarray, order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal (order_by, key, check), numbered in that order: each row's group, and the rows sorted, and where groups begin."""
    order = np.lexsort((check, key, order_by))
    a, b, c = order_by[order], key[order], check[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order, np.flatnonzero(new)


def stretch_rows(blocks: DataFrame, codes: DataFrame, buckets: int, size: int = SIZE) -> DataFrame:
    """Rows of three kinds from every block that shares an anchor with another text.

    ``own``: the stretches (first, suffixes, slot) of the block; those that are equal share a slot, and the slots of a bucket
    are consecutive. ``sent``: the distinct stretches of a bucket from slot ``first`` on. ``single``: suffixes of frequent
    anchors, each with a slot and a hash. An id that goes with a slot is the least of the texts in the block that hold it.
    """
    names = ["kind", "block", "bucket", "first", "a", "b", "c", "d", "ids"]

    def row(kind: str, block: int, bucket, first, a, b, c, d, ids) -> pa.RecordBatch:
        n = len(bucket)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(np.full(n, block, np.int64)), pa.array(bucket), pa.array(first), a, b, c, d, ids], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, pieces = batch.column("block")[r].as_py(), Pieces(batch, r)
                piece, first, last, anchor, name = pieces.stretches(buckets)
                distinct, _ = _anchors(piece, name)
                bucket, bounds = _shares(distinct)
                code = np.zeros(len(distinct), np.uint8)
                got = {x["bucket"]: x["codes"] for x in batch.column("codes")[r].as_py()}
                for b, x, y in zip(bucket.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    if b in got:
                        code[x:y] = np.frombuffer(got[b], np.uint8)
                mine = code[np.searchsorted(distinct, name)]
                some, many = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
                # Stretches of anchors in several texts: equal ones get one slot.
                past = last[some] + size
                slot, order, at = _distinct(*(bytes_hash(pieces.data, first[some], past, k) for k in (0, 1)), name[some])
                ids = pieces.ids[piece[some]]
                if len(some):
                    rep, least = some[order[at]], np.minimum.reduceat(ids[order], at)
                    bucket, bounds = _shares(name[rep])
                    sizes = (last[rep] + size - first[rep]).astype(np.int64)
                    ends = np.append(0, np.cumsum(sizes))
                    text = pieces.data[np.arange(ends[-1]) + np.repeat(first[rep] - ends[:-1], sizes)]
                    low = (name[rep] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    meta = np.stack([sizes, anchor[rep] - first[rep]], axis=1).astype(np.uint8)
                    yield row("sent", block, bucket, bounds[:-1], _cut(text, ends[bounds]), _cut(meta.ravel(), bounds * 2), _cut(low, bounds), pa.nulls(len(bucket), pa.binary()), _cut(least, bounds))
                # Suffixes of frequent anchors, one by one; their slots follow.
                n = last[many] - first[many] + 1
                offsets = np.append(0, np.cumsum(n))
                place = np.arange(offsets[-1]) + np.repeat(first[many] - offsets[:-1], n)
                key, check = (bytes_hash(pieces.data, place, place + size, k) for k in (0, 1))
                single, order, at2 = _distinct(key, check, np.zeros(len(place), np.uint64))
                if len(place):
                    owner = pieces.ids[np.repeat(piece[many], n)]
                    rep, ends = order[at2], np.array([0, len(at2)])
                    yield row("single", block, np.zeros(1, np.int32), np.array([len(at)]), _cut(signed(key[rep]), ends), _cut(signed(check[rep]), ends), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), _cut(np.minimum.reduceat(owner[order], at2), ends))
                    slot = np.concatenate([slot, single + len(at)])
                start = np.concatenate([first[some], place]).astype(np.int32)
                count = np.concatenate([last[some] - first[some] + 1, np.ones(len(place), np.int64)]).astype(np.uint8)
                if len(start):
                    ends = np.array([0, len(start)])
                    yield row("own", block, np.zeros(1, np.int32), np.array([len(at) + len(at2)]), _cut(start, ends), _cut(count, ends), _cut(slot.astype(np.int32), ends), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()))

    listed = codes.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))
    joined = blocks.select("block", "ids", "sizes", "data").join(listed.hint("shuffle_hash"), "block")
    return joined.mapInArrow(run, "kind string, block long, bucket int, first long, a binary, b binary, c binary, d binary, ids binary")


def sort_suffixes(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, before: np.ndarray, group: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each stretch a mask of its suffixes that equal one of another stretch with a smaller id in ``first``.

    Suffixes start in groups by ``group``, the stretch's anchor, and the distance to it (``before`` is that of the stretch's first). Each
    pass sorts the groups by the next 8 bytes, parts them and drops suffixes that are alone.
    """
    n = sizes - size + 1
    ends = np.append(0, np.cumsum(n))
    stretch = np.repeat(np.arange(len(n)), n)
    k = np.arange(ends[-1]) - ends[:-1][stretch]
    mask = np.zeros(len(n), np.uint32)
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    class_ = group[stretch] * size + (before[stretch] - k)
    place = begin[stretch] + k
    rows = np.arange(len(place))
    digits = [None, *range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    for digit in digits:
        if not len(rows):
            return mask
        if digit is None:
            order = np.argsort(class_, kind="stable")
            new = np.ones(len(rows), bool)
            new[1:] = class_[order[1:]] != class_[order[:-1]]
        else:
            value = eight[place[rows] + digit]
            order = np.lexsort((value, class_))
            new = np.ones(len(rows), bool)
            new[1:] = (class_[order[1:]] != class_[order[:-1]]) | (value[order[1:]] != value[order[:-1]])
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        rows, class_ = rows[order[shared]], number[shared]
    if len(rows):
        own = first[stretch[rows]]
        at = np.flatnonzero(np.diff(class_, prepend=-1))
        least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(rows))))
        late = rows[own > least]
        np.bitwise_or.at(mask, stretch[late], (np.uint32(1) << k[late].astype(np.uint32)))
    return mask


def judged(sent: DataFrame, size: int = SIZE) -> DataFrame:
    """(block, first, masks): for the sent stretches of a block from slot ``first`` on, the suffixes that also start in a smaller id."""

    def judge(table: pa.Table) -> pa.Table:
        data, _ = _flat(table.column("a"), np.uint8)
        meta, _ = _flat(table.column("b"), np.uint8)
        low, n = _flat(table.column("c"), np.uint32)
        ids, _ = _flat(table.column("ids"), np.int64)
        sizes, before = (meta.reshape(-1, 2)[:, k].astype(np.int64) for k in (0, 1))
        begin = np.append(0, np.cumsum(sizes))[:-1]
        slot, order, at = _distinct(*(bytes_hash(data, begin, begin + sizes, k) for k in (0, 1)), low)
        rep, first = order[at], np.minimum.reduceat(ids[order], at)
        # Suffixes are only compared where an anchor has several stretches.
        _, anchor, stretches = np.unique(low[rep], return_inverse=True, return_counts=True)
        several = np.flatnonzero(stretches[anchor] > 1)
        mask = np.zeros(len(rep), np.uint32)
        total, start = np.cumsum(sizes[rep[several]] - size + 1), 0
        while start < len(several):  # whole anchors, as many as SORTED allows
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + SORTED, "right"))
            end = int(np.searchsorted(anchor[several], anchor[several[max(end - 1, start)]], "right"))
            part = several[start:end]
            r, start = rep[part], end
            mask[part] = sort_suffixes(data, begin[r], sizes[r], before[r], anchor[part], first[part], size)
        out = np.where(ids > first[slot], np.uint32(0xFFFFFFFF), mask[slot])
        return pa.table({"block": table.column("block"), "first": table.column("first"), "masks": _cut(out, np.append(0, np.cumsum(n)))})

    return sent.groupBy("bucket").applyInArrow(judge, "block long, first long, masks binary")


def judged_singles(single: DataFrame) -> DataFrame:
    """(block, slots): the slots of single suffixes that also start in a smaller id."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key, check, ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("a", "b", "ids"))
                block = np.full(len(key), batch.column("block")[r].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.arange(len(key)) + batch.column("first")[r].as_py()), pa.array(key), pa.array(check), pa.array(ids)], ["block", "slot", "key", "check", "id"])

    rows = single.select("block", "first", "a", "b", "ids").mapInArrow(spread, "block long, slot long, key long, check long, id long")
    first = rows.groupBy("key", "check").agg(F.min("id").alias("least"))
    return rows.join(first, ["key", "check"]).where("id > least").groupBy("block").agg(F.collect_list(F.col("slot").cast("int")).alias("slots"))


def removals(blocks: DataFrame, own: DataFrame, masks: DataFrame, singles: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, sha, at, spans, n_removed, kept_sha256) of the pieces with something to remove; spans are counted in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                pieces = Pieces(batch, r)
                start = np.frombuffer(batch.column("a")[r].as_buffer(), np.int32).astype(np.int64)
                count = np.frombuffer(batch.column("b")[r].as_buffer(), np.uint8).astype(np.int64)
                slot = np.frombuffer(batch.column("c")[r].as_buffer(), np.int32)
                mask = np.zeros(batch.column("first")[r].as_py(), np.uint32)
                for m in batch.column("masks")[r].as_py() or []:
                    part = np.frombuffer(m["masks"], np.uint32)
                    mask[m["first"] : m["first"] + len(part)] = part
                late = batch.column("slots")[r]
                if late.is_valid:
                    mask[np.asarray(late.values)] = 1
                owner = pieces.ids[np.searchsorted(pieces.begin, start, "right") - 1]
                least = np.full(len(mask), LAST_ID, np.int64)
                np.minimum.at(least, slot, owner)
                bits = np.where(owner > least[slot], np.uint32(0xFFFFFFFF), mask[slot])
                some = bits > 0
                start, count, bits = start[some], count[some], bits[some]
                ends = np.append(0, np.cumsum(count))
                k = np.arange(ends[-1]) - np.repeat(ends[:-1], count)
                hit = np.repeat(bits, count) >> k.astype(np.uint32) & 1 > 0
                place = (np.repeat(start, count) + k)[hit]
                cover = np.zeros(len(pieces.data) + 1, np.int32)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + size, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out: list[list] = [[] for _ in range(6)]
                ids, shas, ats = (batch.column(c)[r].values for c in ("ids", "shas", "ats"))
                for p in np.unique(np.searchsorted(pieces.begin, place, "right") - 1).tolist():
                    a, b, at = int(pieces.begin[p]), int(pieces.begin[p + 1]), ats[p].as_py()
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]])))
                    spans = [{"start": x + at, "end": y + at} for x, y in edge.reshape(-1, 2).tolist()]
                    kept = pieces.data[a:b][~gone[a:b]]
                    for o, v in zip(out, (ids[p].as_py(), shas[p].as_py(), at, spans, int(gone[a:b].sum()), hashlib.sha256(kept).digest())):
                        o.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), _SPAN, pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["id", "sha", "at", "spans", "n_removed", "kept"])

    masks = masks.groupBy("block").agg(F.collect_list(F.struct("first", "masks")).alias("masks"))
    small = own.select("block", "first", "a", "b", "c").join(masks, "block", "left").join(singles, "block", "left")
    rows = blocks.join(small.hint("shuffle_hash"), "block")
    return rows.mapInArrow(run, f"id long, sha binary, at long, spans {SPANS}, n_removed long, kept binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a long text's pieces, which overlap, as one list; and what is left of the text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(3)]
        for parts, text in zip(batch.column("parts").to_pylist(), batch.column("text")):
            spans: list[dict] = []
            for s in sorted((s for p in parts for s in p), key=lambda s: s["start"]):
                if spans and s["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s["end"])
                else:
                    spans.append(s)
            kept, at, data = hashlib.sha256(), 0, text.as_buffer()
            for s in spans:
                kept.update(data[at : s["start"]])
                at = s["end"]
            kept.update(data[at:])
            for o, v in zip(out, (spans, sum(s["end"] - s["start"] for s in spans), kept.digest())):
                o.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), pa.array(out[0], _SPAN), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["id", "sha", "spans", "n_removed", "kept"])


def repeats(docs: DataFrame, scratch: Scratch, piece: int = PIECE, frequent: int = FREQUENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept_sha256 of every row of ``docs``.

    Spans are the maximal runs of removed bytes, end exclusive. Null and empty texts have no bytes; texts of under 50
    keep theirs. Rows that share an id are removed from by smaller ids only, never by each other; rows without an id
    come last, likewise. Other columns play no part, and an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    sha = F.unhex(F.sha2(text, 256))
    own = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha")), "own")
    first = scratch.write(own.where(F.col("n_bytes") >= SIZE).groupBy("sha", "n_bytes").agg(F.min("id").alias("first")), "first")
    total = first.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 + total // bucket_bytes

    texts = docs.where(F.octet_length("text") >= SIZE).select(id_.alias("id"), sha.alias("sha"), "text")
    texts = texts.join(first.select("sha", F.col("first").alias("id")).hint("shuffle_hash"), ["sha", "id"])
    blocks = scratch.write(make_blocks(texts, piece=piece), "blocks")
    scratch.release()
    codes = scratch.write(repeated(anchor_rows(blocks, buckets), frequent), "codes")
    scratch.release()
    rows = scratch.write(stretch_rows(blocks, codes, buckets), "stretches", "kind")
    scratch.remove("codes")
    scratch.release()
    masks = scratch.write(judged(rows.where("kind = 'sent'")), "masks")
    singles = scratch.write(judged_singles(rows.where("kind = 'single'")), "singles")
    scratch.release()
    found = removals(blocks, rows.where("kind = 'own'"), masks, singles).dropDuplicates(["id", "sha", "at"])
    found = scratch.write(found, "found")
    for done in ("blocks", "stretches", "masks", "singles"):
        scratch.remove(done)
    scratch.release()

    # A text of one piece is done; the spans of longer ones are put together and applied to the text.
    long = found.join(first.where(F.col("n_bytes") >= SIZE + piece).select("sha", F.col("first").alias("id")), ["sha", "id"])
    long = long.groupBy("id", "sha").agg(F.collect_list("spans").alias("parts"))
    whole = docs.where(F.octet_length("text") >= SIZE + piece).select(id_.alias("id"), sha.alias("sha"), F.col("text").cast("binary").alias("text"))
    whole = whole.join(long, ["id", "sha"]).mapInArrow(_merged, f"id long, sha binary, spans {SPANS}, n_removed long, kept binary").dropDuplicates(["id", "sha"])
    short = found.join(first.where(F.col("n_bytes") < SIZE + piece).select("sha", F.col("first").alias("id")), ["sha", "id"]).select(whole.columns)
    done = scratch.write(short.unionByName(whole), "done")

    out = own.join(first.select("sha", "first"), "sha", "left").join(done, ["id", "sha"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, every).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
    )


def op12_suffixes(spark, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of the kept bytes of every document."""
    rows = repeats(documents(spark, sf_dir), Scratch(spark, "op12"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# Strings as hex digits, two a byte; runs where the next start lies at most 50 bytes on.
ORACLE = """
    WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
    w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS key FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
    f AS (SELECT key, min(doc_id) AS first FROM w GROUP BY key HAVING count(*) > 1),
    m AS (SELECT doc_id, i FROM w JOIN f USING (key) WHERE doc_id > first),
    g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 50 AS new FROM m),
    r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
    e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
    k AS (SELECT d.doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY d.doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
"""
