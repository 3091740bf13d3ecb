"""Near-duplicate texts by an exact Jaccard join over sets of word n-grams.

Texts with equal sets form a class; the join runs over classes. In a common order of all shingles (frequent
ones last), two sets that link share several of the first shingles of either: with ``n - ceil(0.8 n) + l``
first shingles of each, at least ``l`` are shared. So each class deals its first shingles once; classes that
meet others in too few of them link with nothing and leave.

A shingle and a band of sizes name a tile, and only sets of one tile are compared. There, hashed bitmaps bound
the overlap from above by their bit counts; pairs that pass are settled by intersecting the sorted arrays of
shingles.

Only what joins components is compared. In a few rounds every class is held against the hub of one of its
tiles, a class of another component; verified pairs already join most groups of copies. Then only tiles that
still hold classes of different components are searched, and in them only pairs across components. So a group
of a million copies costs a few million comparisons, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, documents
from .textblocks import PLAIN, blocks, mix, signed

SHINGLE = 5
#: A pair links when ``PER_CENT`` of its union is shared.
PER_CENT = 80
#: A shingle that a task meets this often is reported for the common order.
FREQUENT = 8
#: Shingles, at most, that the common order puts last; which they are changes speed only.
ORDERED_LAST = 1 << 17
#: Rows of a tile that one task compares at a time.
TILE_ROWS = 512
#: Bits of the longest bitmaps.
MOST_BITS = 1 << 13
#: Pairs of a tile that are held against each other at a time.
PAIRS = 1 << 20
#: Tiles of so many classes or fewer are told apart by the classes they hold.
LISTED = 200
#: Rounds of hubs before the tiles are searched; more rounds leave the tiles less to do and change no result.
HUB_ROUNDS = 2
#: Parts into which the classes of a frequent shingle are dealt.
PARTS = 64
#: Shingles of a set for each further one that linked sets must share among their first.
SPARE = 16
#: The hubs' rounds read about so many shingles of a set, chosen by the shingles' hashes.
HUB_SHINGLES = 200
#: A shingle that more sets than this deal is dealt in parts.
HOT = 1000
#: Bits of the map that tells which documents a join may need: a megabyte, however many there are.
WANTED_BITS = 1 << 23
#: Different sets of one name that are told apart, at most. At 10**10 sets about five are expected.
CLASHES = 10_000


def shingle_sets(block, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    windows = block.windows(k)
    for i in range(len(block.offsets) - 1):
        a, b = block.bounds[i : i + 2]
        if b - a >= k:
            yield np.unique(windows[a : b - k + 1])
        else:
            yield block.sequence(i) if b > a else np.zeros(0, np.uint64)


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Two independent 63-bit names (rows) of every set: the second stands in where sets share the first. Empty sets: -1."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    out, real = np.full((2, len(sets)), -1, np.int64), size > 0
    if real.any():
        shingles, starts = np.concatenate(sets), (np.cumsum(size) - size)[real]
        for row, by in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
            total = np.add.reduceat(mix(shingles ^ np.uint64(by)), starts)
            out[row, real] = (mix(total ^ mix(size[real].astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
    return out


def class_names(sets: list[np.ndarray], clashes: np.ndarray) -> list[int]:
    """The names of the sets' classes, given the first names that several sets share."""
    name, other = set_names(sets)
    return np.where(np.isin(name, clashes), other, name).tolist()


def overlap_needed(n: np.ndarray, m: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Least shared shingles at which sets of n and m link: 100 i >= p (n + m - i)."""
    return -(-per_cent * (n + m) // (100 + per_cent))


def prefix_size(n: int, per_cent: int = PER_CENT) -> int:
    """So many first shingles of a set are dealt: n - ceil(0.8 n) + l, with l of ``1 + n // SPARE``."""
    return min(n, n - -(-per_cent * n // 100) + 1 + n // SPARE)


def shared_at_least(n: Column, per_cent: int = PER_CENT) -> Column:
    """So many of a set's first shingles another must deal too to link: the least ``l`` of sets it can link with.

    Of the first shingles of whichever set's end comes first in the order, all but n - ceil(0.8 n) lie in the
    other set, before the end of its own first ones.
    """
    return 1 + F.floor(F.ceil(per_cent * n / 100) / SPARE)


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` (a power of two) in which every shingle sets one."""
    out = np.zeros(bits, bool)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out)


def bitmap_bits(n: int) -> int:
    """A power of two from 8 to 16 bits a shingle, up to ``MOST_BITS``; a longer set's bound is weaker, not wrong."""
    return min(MOST_BITS, max(64, 1 << (8 * n - 1).bit_length()))


def bound(n, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of a set of n with others: each bit that only it has is a shingle they lack."""
    return n - np.bitwise_count(own & ~others).sum(axis=-1, dtype=np.int64)


def _row(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(column)]


def _maps(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(column)]


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """kind 0: (id, n, cls, other, spelling) of a document's set. kind 1: a shingle, how many sets of one task hold it at least.

    ``other`` is the set's second name and ``spelling`` a hash of the text, which finds it again.
    """
    names = ["kind", "id", "n", "cls", "other", "spelling"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(pending), return_counts=True)
            keys, n = signed(keys[n >= FREQUENT]), n[n >= FREQUENT]
            pending.clear()
            none = np.zeros(len(keys), np.int64)
            return out(np.ones(len(keys), np.int32), keys, n, none, none, none)

        def out(*columns) -> pa.RecordBatch:
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            sizes, first, second = [], [], []
            for block in blocks(batch.column("text"), PLAIN, lower=True):
                sets = list(shingle_sets(block, k))
                names_ = set_names(sets)
                sizes += map(len, sets)
                first += names_[0].tolist()
                second += names_[1].tolist()
                for s, name in zip(sets, names_[0].tolist()):
                    if len(s) and name not in seen:
                        seen.add(name)
                        pending.append(s)
                        size += len(s)
                if size > 4_000_000:
                    yield frequent()
                    size = 0
                    if len(seen) > 1_000_000:
                        seen.clear()
            yield out(np.zeros(len(sizes), np.int32), batch.column("doc_id"), *(np.array(x, np.int64) for x in (sizes, first, second)), batch.column("spelling"))
        if pending:
            yield frequent()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("spelling"))
    return rows.mapInArrow(run, "kind int, id long, n long, cls long, other long, spelling long")


def clashing(own: DataFrame) -> np.ndarray:
    """First names that different sets share; raises beyond ``CLASHES``."""
    shared = own.where("n > 0").groupBy("cls").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least < most")
    found = [r[0] for r in shared.select("cls").limit(CLASHES + 1).collect()]
    if len(found) > CLASHES:
        raise RuntimeError(f"op2: more than {CLASHES} names are shared by different sets")
    return np.array(found, np.int64)


def tiles(docs: DataFrame, last: np.ndarray, clashes: np.ndarray, k: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """(shingle, cls, common): the first shingles of all sets, each set once in a task. ``common``: the order puts it last."""
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = sent.value, set()
        for batch in batches:
            for block in blocks(batch.column("text"), PLAIN, lower=True):
                keys, names, flags = [], [], []
                sets = list(shingle_sets(block, k))
                for s, name in zip(sets, class_names(sets, clashes)):
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    n = prefix_size(len(s), per_cent)
                    if len(late):
                        at = np.searchsorted(late, s)
                        common = late[np.minimum(at, len(late) - 1)] == s
                        s, common = (np.concatenate([x[~common], x[common]])[:n] for x in (s, common))
                    else:
                        s, common = s[:n], np.zeros(n, bool)
                    keys.append(s)
                    names.append(np.full(n, name, np.int64))
                    flags.append(common)
                if len(seen) > 1_000_000:
                    seen.clear()
                if keys:
                    arrays = [signed(np.concatenate(keys)), np.concatenate(names), np.concatenate(flags)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["shingle", "cls", "common"])

    return docs.select("text").mapInArrow(run, "shingle long, cls long, common boolean")


def met(rows: DataFrame) -> DataFrame:
    """(shingle, cls, heat) that another class may deal too, from one exchange of ``tiles``.

    A rare shingle is dealt as a whole, and stays if two classes hold it; its rows are its heat. Those of the
    common order's end may be held by any share of all sets; they are dealt in parts and stay, as the hottest.
    """
    part = F.when(F.col("common"), F.pmod(F.xxhash64("cls"), F.lit(PARTS))).otherwise(F.lit(0))
    dealt = rows.withColumn("part", part).repartition("shingle", "part")
    own = Window.partitionBy("shingle", "part")
    heat = F.when(F.col("common"), F.lit(1 << 62)).otherwise(F.count("*").over(own))
    marked = dealt.withColumns({"least": F.min("cls").over(own), "most": F.max("cls").over(own), "heat": heat})
    return marked.where("common OR least < most").dropDuplicates(["shingle", "part", "cls"]).select("shingle", "cls", "heat")


def active_classes(shared: DataFrame, own: DataFrame) -> DataFrame:
    """(cls, n, held, id, spelling) of classes that meet others in enough of their first shingles to link, with one text of each."""
    held = shared.groupBy("cls").agg(F.count("*").alias("held"))
    classes = own.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min(F.struct("id", "spelling")).alias("text"))
    return held.join(classes, "cls").where(F.col("held") >= shared_at_least(F.col("n"))).select("cls", "n", "held", "text.id", "text.spelling")


def cooler(shared: DataFrame, active: DataFrame) -> DataFrame:
    """(cls, n, held, tiles): the shingles, with their heat, of active classes, without the hottest few of each.

    Linked sets share at least ``l`` of the dealt shingles. Were the coolest of those among the ``l - 1`` hottest
    of one set, all would be; so both keep it, and that much can go. A class is one row, so that later joins by
    class move little.
    """
    mine = F.array_sort(F.collect_list(F.struct("heat", "shingle")))
    own = active.select("cls", "n", "held").join(shared.groupBy("cls").agg(mine.alias("tiles")), "cls")
    return own.withColumn("tiles", F.slice("tiles", 1, F.greatest(F.size("tiles") - (shared_at_least(F.col("n")) - 1).cast("int"), F.lit(1))))


def dealt(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(shingle, heat, cls, n, held, label): a row for each shingle of each class, with the class's component."""
    if labels is None:
        named = classes.withColumn("label", F.col("cls"))
    else:
        named = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return named.select("cls", "n", "held", "label", F.explode("tiles").alias("t")).select("t.shingle", "t.heat", "cls", "n", "held", "label")


def banded(rows: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """``rows`` in their tiles: a shingle and a band of sizes. ``visits``: 0 in a set's own band, 1 in the next.

    Sets that link are in one band or in neighbours, so they meet where one of them is at home.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / per_cent)) + 1e-9).cast("int")
    return rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("visits")).withColumn("tile", band + F.col("visits"))


def sampled(classes: DataFrame) -> DataFrame:
    """``classes`` with some shingles of the larger sets only: those of every larger set's sample are in a smaller's."""
    rate = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.col("n") / HUB_SHINGLES)))).cast("long")
    return classes.withColumn("rate", rate).withColumn("tiles", F.filter("tiles", lambda t: F.pmod(F.xxhash64(t["shingle"]), F.col("rate")) == 0)).drop("rate")


def star(named: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(a, b): every class with the hub it shares most tiles with, among hubs of other components.

    ``named``: shingle, cls, n, held, label. A tile's hub is first its class that meets others most often, which
    in a group of copies is likely the text that all were made from; in later rounds its least class by a hash of
    the round. The hub of a tile that holds one component asks for nothing.
    """
    placed = banded(named)
    rank = F.struct((-F.col("held")).alias("r") if k == 0 else F.xxhash64("cls", F.lit(k)).alias("r"), "cls", "label", "visits")
    hubs = placed.groupBy("shingle", "tile").agg(F.min(rank).alias("hub"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    hubs = hubs.select("shingle", "tile", F.col("hub.cls").alias("hub"), F.col("hub.label").alias("hub_label"), F.col("hub.visits").alias("hub_visits"))
    hubs = scratch.write(hubs, f"hubs{k}")  # written, so that a hot tile's side of the join can be split
    votes = placed.join(hubs, ["shingle", "tile"]).where("label <> hub_label AND visits + hub_visits < 2").groupBy("cls", "hub").agg(F.count("*").alias("n"))
    best = votes.groupBy("cls").agg(F.min_by("hub", F.struct(-F.col("n"), "hub")).alias("hub"))
    return best.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()


def open_tiles(named: DataFrame) -> DataFrame:
    """(shingle, cls, n, label, heat) of shingles that classes of two components or more deal, and of hot ones.

    Shingles of equal short lists of classes ask the same question; one of them stays.
    """
    part = F.when(F.col("heat") > HOT, F.pmod(F.xxhash64("cls"), F.lit(PARTS))).otherwise(F.lit(0))
    own = Window.partitionBy("shingle", "part")
    rows = named.withColumn("part", part).repartition("shingle", "part")
    rows = rows.withColumns({"least": F.min("label").over(own), "most": F.max("label").over(own)})
    rows = rows.where((F.col("least") < F.col("most")) | (F.col("heat") > HOT))
    lists = rows.where(F.col("heat") <= LISTED).groupBy("shingle", "part").agg(F.array_sort(F.collect_list(F.struct("cls", "n", "label"))).alias("list"), F.first("heat").alias("heat"))
    single = lists.groupBy("list").agg(F.min(F.struct("shingle", "heat")).alias("one")).select("one.*", F.explode("list").alias("x"))
    return single.select("shingle", "x.*", "heat").unionByName(rows.where(F.col("heat") > LISTED).select("shingle", "cls", "n", "label", "heat"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the documents that ``wanted`` (cls, id, spelling) names, a null id included.

    A bitmap of the wanted spellings' hashes, of a fixed size, leaves most other texts out before they are dealt. It is
    looked up without Python: what reads the texts then is the only Python worker of its task.
    """
    at = lambda spelling: F.pmod(F.xxhash64(spelling), F.lit(WANTED_BITS)) + 1  # noqa: E731  Spark counts bits and pages from 1
    pages = wanted.select(at("spelling").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text").withColumn("at", at("own"))
    rows = rows.join(F.broadcast(pages), F.bitmap_bucket_number("at") == F.col("page"))
    bit = F.bitmap_bit_position("at")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    rows = rows.where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("long")) != 0).select("doc_id", "own", "text")
    return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["own"] == wanted["spelling"])).select("cls", "text")


def maps_of(docs: DataFrame, active: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(cls, n, bits): the bitmaps of the classes ``active``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, maps = [], []
            for block in blocks(batch.column("text"), PLAIN, lower=True):
                for s in shingle_sets(block, k):
                    sizes.append(len(s))
                    maps.append(bitmap(s, bitmap_bits(len(s))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["cls", "n", "bits"])

    # Rows that repeat an id and a text are one.
    return texts_of(docs, active.select("cls", "id", "spelling")).mapInArrow(run, "cls long, n long, bits binary").dropDuplicates(["cls"])


def sets_of(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(cls, shingles) of the classes ``wanted``, from the texts of the documents that it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [s.tobytes() for block in blocks(batch.column("text"), PLAIN, lower=True) for s in shingle_sets(block, k)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(arrays, pa.binary())], ["cls", "shingles"])

    return texts_of(docs, wanted).mapInArrow(run, "cls long, shingles binary")


def bounded(pairs: DataFrame, maps: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Those pairs (a, b) of classes whose sizes and bit counts allow a link. ``maps``: cls, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), _maps(batch, "x"), _maps(batch, "y")):
                width = min(len(x), len(y))
                x, y = (np.bitwise_or.reduce(v.reshape(-1, width)) for v in (x, y))
                keep.append(int(bound(n, x, y)) >= overlap_needed(n, m, per_cent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (maps.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    near = (100 * F.col("n_a") >= per_cent * F.col("n_b")) & (100 * F.col("n_b") >= per_cent * F.col("n_a"))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, active: DataFrame, docs: DataFrame, scratch: Scratch, name: str, k: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """Those pairs (a, b) of classes that link, by intersecting the sorted arrays of their shingles.

    Arrays are made for the classes of ``pairs`` alone, from one text of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(x) + len(y) - len(np.union1d(x, y)) >= overlap_needed(len(x), len(y), per_cent) for x, y in zip(_row(batch, "x"), _row(batch, "y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = active.join(asked, "cls").select("cls", "id", "spelling")
    sets = scratch.write(sets_of(docs, wanted, k), f"{name}-sets")
    scratch.release()
    left, right = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    linked = scratch.write(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), name)
    scratch.remove(f"{name}-sets")
    scratch.release()
    return linked


def across(rows: DataFrame, maps: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """Candidate pairs (a, b) of classes in one tile but different components, whose bit counts allow a link.

    ``rows``: shingle, cls, n, label, heat. A tile of many rows is cut into parts that meet two at a time, so no task
    holds more than ``2 * TILE_ROWS`` of them.
    """
    placed = scratch.write(banded(rows, per_cent), "placed")
    hot = placed.where(F.col("heat") > TILE_ROWS)
    size = hot.groupBy("shingle", "tile").agg(F.count("*").alias("rows"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    size = scratch.write(size.select("shingle", "tile", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("parts")), "sizes")
    placed = placed.where(F.col("heat") <= TILE_ROWS).withColumn("parts", F.lit(1)).unionByName(hot.join(size, ["shingle", "tile"]))
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    met_ = placed.withColumn("part", part).withColumn("meet", F.explode(meets))
    ready = met_.join(maps.select("cls", "bits"), "cls").select("shingle", "tile", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "part", "visits", "cls", "label", "n", "bits")
    keys = ["shingle", "tile", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            edge = [table.column(c).to_numpy() for c in keys]
            new = np.flatnonzero(np.any([np.diff(x) != 0 for x in edge], axis=0)) + 1
            whole = int(new[-1]) if len(new) else 0  # the last group may go on in the next batch
            rest = table.slice(whole)
            if whole:
                yield _candidates(table.slice(0, whole), np.append(0, new[:-1]), per_cent)
        if rest is not None:
            edge = [rest.column(c).to_numpy() for c in keys]
            yield _candidates(rest, np.append(0, np.flatnonzero(np.any([np.diff(x) != 0 for x in edge], axis=0)) + 1), per_cent)

    return ready.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _candidates(table: pa.Table, starts: np.ndarray, per_cent: int) -> pa.RecordBatch:
    """Pairs of rows of one group (from one of ``starts`` to the next) that pass size and bit counts, each once."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
    order = np.lexsort((table.column("n").to_numpy(), group))
    cls, label, n, part, visits, i, j = (table.column(c).to_numpy()[order] for c in ("cls", "label", "n", "part", "visits", "i", "j"))
    group, apart = group[order], i != j
    bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits").combine_chunks()]
    bits = [bits[k] for k in order]
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    top = int(n.max()) * 2 + 2  # above every size that is looked for
    past = np.searchsorted(group * top + n, group * top + n * 100 // per_cent, "right")
    count = past - np.arange(len(n)) - 1
    out, row, run = [], 0, np.cumsum(count)
    while row < len(n):
        end = max(row + 1, int(np.searchsorted(run, (run[row - 1] if row else 0) + PAIRS, "right")))
        size = count[row:end]
        total = np.cumsum(size)
        x = np.repeat(np.arange(row, end), size)
        y = np.arange(int(total[-1])) - np.repeat(total - size, size) + x + 1
        near = (label[x] != label[y]) & (visits[x] + visits[y] < 2) & (~apart[x] | (part[x] != part[y]))
        x, y, row = x[near], y[near], end
        a, b = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])
        by = np.lexsort((b, a))  # a pair of many tiles is bounded once
        first = np.append(True, (np.diff(a[by]) != 0) | (np.diff(b[by]) != 0))[: len(by)]
        x, y = x[by[first]], y[by[first]]
        low = np.minimum(width[x], width[y])
        for w in np.unique(low).tolist():
            p, q = x[low == w], y[low == w]
            rows, place = np.unique(np.concatenate([p, q]), return_inverse=True)
            signs = np.stack([np.bitwise_or.reduce(bits[k].reshape(-1, w)) for k in rows]).view(np.uint64)
            step = max(1, (1 << 25) // w)
            for s in range(0, len(p), step):
                u, v = place[: len(p)][s : s + step], place[len(p) :][s : s + step]
                m = n[p[s : s + step]]
                keep = bound(m, signs[u], signs[v]) >= overlap_needed(m, n[q[s : s + step]], per_cent)
                out.append(np.stack([cls[p[s : s + step]][keep], cls[q[s : s + step]][keep]]))
    found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found.min(axis=0)), pa.array(found.max(axis=0))], ["a", "b"])


def link(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """(id, n, cls, component) of every row of ``docs``: set size, class, and the least id it can reach by links.

    Null and empty texts have an empty set and link with nothing, not even each other. Rows that repeat an
    id are judged by their texts; a row without an id links others but has no name of its own to give. An
    empty table gives no rows. Other columns play no part.
    """
    found = scratch.write(describe(docs, k), "found")
    own = found.where("kind = 0").drop("kind")
    clashes = clashing(own)
    if len(clashes):
        own = own.withColumn("cls", F.when(F.col("cls").isin(clashes.tolist()), F.col("other")).otherwise(F.col("cls")))
    often = found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(ORDERED_LAST)
    last = np.sort(np.array([r[0] for r in often.select("id").collect()], np.int64).view(np.uint64))
    shared = scratch.write(met(tiles(docs, last, clashes, k, per_cent)), "met")
    scratch.release()
    active = scratch.write(active_classes(shared, own), "active")
    maps = scratch.write(maps_of(docs, active, k), "maps")
    classes = scratch.write(cooler(shared, active), "tiles")
    scratch.remove("met")
    scratch.release()

    some = scratch.write(sampled(classes), "some")
    linked, labels = None, None
    for round_ in range(HUB_ROUNDS):
        pairs = scratch.write(bounded(star(dealt(some, labels), round_, scratch), maps, per_cent), f"star{round_}")
        found_links = verify(pairs, active, docs, scratch, f"star-links{round_}", k, per_cent)
        linked = found_links if linked is None else linked.unionByName(found_links)
        labels = components(linked, scratch, f"near{round_}").withColumnRenamed("node", "cls")
    more = scratch.write(across(open_tiles(dealt(classes, labels)), maps, scratch, per_cent), "candidates")
    scratch.release()
    edges = linked.unionByName(verify(more, active, docs, scratch, "more-links", k, per_cent))
    labels = components(edges, scratch, "all")

    named_own = own.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = scratch.write(named_own.where("n > 0").groupBy("label").agg(F.min("id").alias("component")), "least")
    joined = named_own.join(least, "label", "left")
    return joined.select("id", "n", "cls", F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component"))


def deduplicate(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that name their component, with their own columns: one document of each group.

    Decisions are by id: an id stays, with all its rows, if one of them names its component. Rows without an
    id stay.
    """
    own = link(docs, scratch).where("id = component OR id IS NULL").select(F.col("id").alias("kept_id")).distinct()
    own = scratch.write(own, "kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    kept = rows.join(own, rows["doc.doc_id"].cast("long").eqNullSafe(own["kept_id"]), "left_semi")
    return kept.select("doc.*")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    found = link(documents(spark, sf_dir), Scratch(spark, "op2"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
    g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT g.b, r.reach FROM r JOIN g ON g.a = r.node WHERE r.reach < g.b),
    m AS (SELECT node, min(reach) AS reach FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.reach AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""
