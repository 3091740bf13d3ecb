"""A hidden Markov language model over words.

Words are counted over all training texts, and every word has an emission of its own in every state. Those of
the ``KNOWN`` most frequent travel with the tasks; the others, of any number, stay in a table (word, one column a
state) that is joined to the texts that hold them. Baum-Welch expectations are taken in every task over whole
texts, summed across partitions by word, and give the next parameters.

A text is cut into windows that are worked side by side. For the longer texts each window is a transfer matrix
first; their products carry the forward and backward vectors over the cuts, so that expectations and the
likelihood, by the scaled forward recursion, are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .op06_language import held_out
from .shared import Scratch, documents
from .textblocks import PLAIN, KeyTable, blocks, signed

STATES = 6
#: Bound on the words whose counts and emissions are sent to all tasks.
KNOWN = 1 << 18
#: Passes of Baum-Welch over all training texts.
PASSES = 2
#: The most frequent words whose meetings in texts give the starting point.
SEEDS = 256
WINDOW = 256
#: Windows that are worked side by side.
SIDE_BY_SIDE = 1024
#: Steps after which products are scaled; so many emissions, the least of which is 0.5 over the corpus' size, do not reach the least double.
SCALED = 8
#: Key of the token that ends every text.
END = np.uint64(0x9D5C_7A3B_11E0_4F27)
#: Share of the overall word distribution in every state's. A word that no training text has is as likely as in the base.
SMOOTH = 0.2


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys of all tokens, past-last token of each text) of each block: its words, then one end."""
    for block in blocks(batch.column("text"), PLAIN, lower=True):
        words = np.diff(block.bounds)
        ends = np.cumsum(words + 1)
        keys = np.full(int(ends[-1]), END, np.uint64)
        keep = np.ones(len(keys), bool)
        keep[ends - 1] = False
        keys[keep] = block.hashes
        yield keys, ends


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n) of all tokens of ``docs``, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for keys, _ in _tokens(batch):
                held.append(keys)
                size += len(keys)
                if size > 6_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Keys and counts of the most frequent words, and the corpus' totals."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V

    @classmethod
    def of(cls, counts: DataFrame, known: int = KNOWN) -> Vocabulary:
        """Words from the least count on that no more than ``known`` words reach, found from the counts' histogram.

        The histogram has a row for each different count, of which there are at most the square root of twice the tokens.
        """
        sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
        down = Window.orderBy(F.desc("n"))
        sizes = sizes.withColumn("above", F.sum("words").over(down))
        row = sizes.agg(
            F.min(F.when(F.col("above") <= known, F.col("n"))).alias("known"),
            F.coalesce(F.sum(F.col("words") * F.col("n")), F.lit(0)).alias("tokens"),
            F.coalesce(F.max("above"), F.lit(0)).alias("distinct"),
        ).first()
        top = counts.where(F.col("n") >= (row["known"] if row["known"] is not None else 1 << 62)).toArrow()
        keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = np.lexsort((keys, -n))
        return cls(keys[order], n[order], row["tokens"], row["distinct"])

    @property
    def base_size(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def shares(self) -> np.ndarray:
        """Share of all tokens that each known word has; none is 0, and all words and the unknown one share 1."""
        return (self.counts + 0.5) / self.base_size


ENCODED = "doc_id long, held_out boolean, n_tokens long, places binary, log_base double, n_known long, others binary"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every text as places of four bytes: of a known word, or, counted on from their number, of a word of ``others``.

    ``others`` are the text's distinct other keys in ascending order. ``log_base`` and ``n_known`` sum over known words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        table = KeyTable(len(v.keys))
        table.add(v.keys)
        log_count = np.append(np.log10(v.counts + 0.5), 0.0)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for keys, ends in _tokens(batch):
                place = table.find(keys).astype(np.int64)
                known = place >= 0
                cuts = np.append(0, ends)
                sums = [np.diff(np.append(0.0, np.cumsum(x))[cuts]) for x in (log_count[place], known)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    own, lacking = place[a:b].astype(np.int32), ~known[a:b]
                    others, at = np.unique(keys[a:b][lacking], return_inverse=True)
                    own[lacking] = at + len(v.keys)
                    for column, x in zip(out, (b - a, own.tobytes(), sums[0][i], sums[1][i], others.tobytes())):
                        column.append(x)
            kinds = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.binary())
            arrays = [pa.array(x, t) for x, t in zip(out, kinds)]
            arrays[3] = arrays[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], ["doc_id", "held_out", "n_tokens", "places", "log_base", "n_known", "others"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, ENCODED)


@dataclass
class Model:
    """start (states), move (states x states), emit (known words x states), the emission of a word that no training text
    has, and what a word's share is divided by in each state before any pass."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    unseen: np.ndarray
    whole: np.ndarray | None = None


def _grid(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of emissions (tokens x states), longest first, as one array: tokens x parts x states."""
    out = np.ones((len(parts[0]), len(parts), parts[0].shape[1]))
    for i, p in enumerate(parts):
        out[: len(p), i] = p
    return out


def transfer(move: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The product of move and emission over each part (longest first), scaled to sum 1, and log10 of the scale."""
    k, sizes, emitted = len(move), np.array([len(p) for p in parts]), _grid(parts)
    product, scale = np.tile(np.eye(k), (len(parts), 1, 1)), np.zeros(len(parts))
    for t in range(len(emitted)):
        live = int(np.searchsorted(-sizes, -t))  # parts longer than t come first
        step = (product[:live].reshape(-1, k) @ move).reshape(live, k, k)
        np.multiply(step, emitted[t, :live][:, None, :], out=product[:live])
        if t % SCALED == SCALED - 1 or t == len(emitted) - 1:  # parts that ended since are scaled here too
            norm = product.reshape(len(parts), -1).sum(axis=1)
            product /= norm[:, None, None]
            scale += np.log10(norm)
    return product, scale


@dataclass
class Windows:
    """Windows of some texts with the vectors before and behind each, and each text's log10 probability."""

    parts: list[np.ndarray]
    text: np.ndarray
    at: np.ndarray  # first token in its text
    before: np.ndarray
    behind: np.ndarray
    log: np.ndarray

    @classmethod
    def of(cls, model: Model, texts: list[np.ndarray]) -> Windows:
        """``texts``: the emissions of every token (tokens x states)."""
        k, count = len(model.start), [max(1, -(-len(t) // WINDOW)) for t in texts]
        text = np.repeat(np.arange(len(texts)), count)
        at = np.concatenate([np.arange(c) * WINDOW for c in count])
        parts = [texts[i][a : a + WINDOW] for i, a in zip(text, at)]
        before, behind, log = np.tile(model.start, (len(parts), 1)), np.ones((len(parts), k)), np.zeros(len(texts))
        long = sorted(np.flatnonzero(np.repeat(np.array(count) > 1, count)), key=lambda p: -len(parts[p]))
        products: dict[int, tuple] = {}
        for a in range(0, len(long), SIDE_BY_SIDE):
            some = long[a : a + SIDE_BY_SIDE]
            products.update(zip(some, zip(*transfer(model.move, [parts[p] for p in some]))))
        first = np.cumsum(count) - count
        for i in np.flatnonzero(np.array(count) > 1):
            row = model.start
            for p in range(first[i], first[i] + count[i]):
                before[p] = row
                row = row @ products[p][0]
                log[i] += products[p][1] + np.log10(row.sum())
                row = row / row.sum()
            row = np.ones(k)
            for p in reversed(range(first[i], first[i] + count[i])):
                behind[p] = row
                row = products[p][0] @ row
                row = row / row.sum()
        # The other texts are one window; a plain recursion gives their probability.
        short = sorted(first[np.array(count) == 1], key=lambda p: -len(parts[p]))
        for a in range(0, len(short), SIDE_BY_SIDE):
            some = np.array(short[a : a + SIDE_BY_SIDE])
            log[text[some]] = forward(model.move, _grid([parts[p] for p in some]), np.array([len(parts[p]) for p in some]), before[some])[2]
        return cls(parts, text, at, before, behind, log)


def forward(move: np.ndarray, emitted: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled vectors before every token (and behind the last), their norms, and the sums of the norms' log10."""
    width, n, k = emitted.shape
    out, norms = np.zeros((width + 1, n, k)), np.ones((width, n))
    out[0] = before
    for t in range(width):
        m = int(np.searchsorted(-sizes, -t))
        step = (out[t, :m] @ move) * emitted[t, :m]
        norms[t, :m] = step.sum(axis=1)
        out[t + 1, :m] = step / norms[t, :m, None]
    return out, norms, np.log10(norms).sum(axis=0)


def expect(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Expected starts and moves of all texts, and for each token of every text the chances of its states."""
    k, w = len(model.start), Windows.of(model, texts)
    starts, moves = np.zeros(k), np.zeros((k, k))
    states = [np.zeros(t.shape) for t in texts]
    order = sorted(range(len(w.parts)), key=lambda p: -len(w.parts[p]))
    for a in range(0, len(order), SIDE_BY_SIDE):
        some = np.array(order[a : a + SIDE_BY_SIDE])
        sizes, emitted = np.array([len(w.parts[p]) for p in some]), _grid([w.parts[p] for p in some])
        ahead_of, norms, _ = forward(model.move, emitted, sizes, w.before[some])
        last = ahead_of[sizes, np.arange(len(some))]
        back = w.behind[some] / (last * w.behind[some]).sum(axis=1, keepdims=True)
        chances = np.zeros(emitted.shape)
        for t in reversed(range(len(emitted))):
            m = int(np.searchsorted(-sizes, -t))
            chances[t, :m] = ahead_of[t + 1, :m] * back[:m]
            ahead = emitted[t, :m] * back[:m] / norms[t, :m, None]
            moves += ahead_of[t, :m].T @ ahead
            back[:m] = ahead @ model.move.T
        first = w.at[some] == 0
        starts += (ahead_of[0] * back)[first].sum(axis=0)
        for i, p in enumerate(some):
            states[w.text[p]][w.at[p] : w.at[p] + sizes[i]] = chances[: sizes[i], i]
    return starts, moves * model.move, states


def _emissions(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, keys of other words, emissions of every token) of each row; other words' come from the row's ``tail``."""
    k, known = len(model.start), len(model.emit)
    tails = batch.column("tail")
    for i, (places, others) in enumerate(zip(batch.column("places"), batch.column("others"))):
        place, keys = np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(others.as_buffer(), np.uint64)
        own = np.tile(model.unseen, (len(keys), 1))
        if len(keys) and tails[i].is_valid:
            tail = tails[i].values
            at = np.searchsorted(keys, tail.field("key").to_numpy().view(np.uint64))
            own[at] = np.stack([tail.field(f"s{s}").to_numpy() for s in range(k)], axis=1)
        table = model.emit[np.minimum(place, max(known - 1, 0))] if known else np.zeros((len(place), k))
        late = place >= known
        if late.any():
            table[late] = own[place[late] - known]
        yield place, keys, table


def _held(rows: Iterator, most: int = 200_000) -> Iterator[list]:
    """Lists of consecutive rows with about ``most`` tokens, one row at least."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[0])
        if size > most:
            yield out
            out, size = [], 0
    if out:
        yield out


def tail_columns(k: int) -> str:
    return ", ".join(f"s{s} double" for s in range(k))


def partial_expectations(texts: DataFrame, model: Model) -> DataFrame:
    """Expectations of each task's texts: kind 0, a known word's place; 1, another word's key; 2, moves by state, then starts.

    A task hands on a row for almost every known word, however few texts it has, so there are two tasks a core and
    not one for each partition. Texts pass through a task; what it holds does not grow with them.
    """
    sent, k, n = texts.sparkSession.sparkContext.broadcast(model), len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, moves, starts = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)

        def rows(kind: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            arrays = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), *(pa.array(values[:, s]) for s in range(k))]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "key", *(f"s{s}" for s in range(k))])

        for batch in batches:
            for some in _held(_emissions(batch, sent.value)):
                first, step, states = expect(sent.value, [x[2] for x in some])
                starts, moves = starts + first, moves + step
                place, chance = np.concatenate([x[0] for x in some]), np.concatenate(states)
                here = place < n
                for s in range(k):
                    known[:, s] += np.bincount(place[here], chance[here, s], minlength=n)[:n]
                late = [x[1][x[0][x[0] >= n] - n] for x in some]
                if any(map(len, late)):
                    keys, at = np.unique(np.concatenate(late), return_inverse=True)
                    yield rows(1, keys.view(np.int64), np.stack([np.bincount(at, chance[~here, s], minlength=len(keys)) for s in range(k)], axis=1))
        used = np.flatnonzero(known.any(axis=1))
        yield rows(0, used, known[used])
        yield rows(2, np.arange(k + 1), np.concatenate([moves, starts[None]]))

    schema = f"kind int, key long, {tail_columns(k)}"
    some = texts.select("places", "others", "tail").coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    return some.mapInArrow(run, schema)


def expectations(texts: DataFrame, model: Model) -> DataFrame:
    """The sums of ``partial_expectations`` by kind and key."""
    columns = [f"s{s}" for s in range(len(model.start))]
    return partial_expectations(texts, model).groupBy("kind", "key").agg(*(F.sum(c).cast("float").alias(c) for c in columns))


def meetings(encoded: DataFrame, seeds: int) -> np.ndarray:
    """How many texts hold each two of the first ``seeds`` known words, over all of ``encoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((seeds, seeds))
        for batch in batches:
            held = np.zeros((len(batch), seeds), np.float32)
            for i, x in enumerate(batch.column("places")):
                place = np.frombuffer(x.as_buffer(), np.int32)
                held[i, place[place < seeds]] = 1
            total += held.T @ held
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "n"])

    rows = encoded.select("places").mapInArrow(run, "a long, b long, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((seeds, seeds))
    out[rows.column("a").to_numpy(), rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    return out


def starting_point(met: np.ndarray, vocabulary: Vocabulary, states: int = STATES) -> Model:
    """States that tend to stay, each leaning to one cluster of the seeds; all other words are alike in every state.

    Seeds are placed by the leading directions of their meetings over chance, and clustered from the most
    spread seeds on; everything is fixed by the counts.
    """
    shares, unseen = vocabulary.shares(), 0.5 / vocabulary.base_size
    lean = np.ones((len(shares), states))
    if len(met):
        one = np.maximum(np.diag(met), 1.0)
        over = np.log1p(met * one.max() / np.outer(one, one))
        over -= over.mean(axis=0)
        value, vector = np.linalg.eigh(over @ over.T)
        place = vector[:, -states:] * np.sqrt(np.maximum(value[-states:], 0))
        centre = place[[int(np.argmax((place**2).sum(axis=1)))]]
        while len(centre) < min(states, len(place)):
            away = ((place[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
            centre = np.concatenate([centre, place[[int(np.argmax(away))]]])
        for _ in range(20):
            near = ((place[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            centre = np.stack([place[near == c].mean(axis=0) if (near == c).any() else centre[c] for c in range(len(centre))])
        lean[np.arange(len(place)), near] = 8.0
    emit = shares[:, None] * lean
    whole = (emit.sum(axis=0) + 1.0 - unseen - shares.sum()) / (1.0 - unseen) if len(shares) else np.ones(states)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / whole, np.full(states, unseen), whole)


class Trainer:
    """The model's broadcast part and the table of its other words' emissions: key, n, one column a state."""

    def __init__(self, encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, scratch: Scratch, states: int = STATES):
        self.encoded, self.vocabulary, self.scratch, self.k = encoded, vocabulary, scratch, states
        least = int(vocabulary.counts.min()) if len(vocabulary.counts) else 1 << 62
        self.others = counts.where(F.col("n") < least)
        training = encoded.where(~F.col("held_out"))
        seeds = min(SEEDS, len(vocabulary.keys))
        self.model = starting_point(meetings(training, seeds) if seeds else np.zeros((0, 0)), vocabulary, states)
        share = (F.col("n") + 0.5) / vocabulary.base_size
        self.table = self.others.select("key", "n", *((share / float(self.model.whole[s])).cast("float").alias(f"s{s}") for s in range(states)))
        self.rows = scratch.write(self._rows(), "others")

    def _rows(self) -> DataFrame:
        """(row, key, held_out) of every text's other words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("others")]
                size = [len(x) for x in keys]
                arrays = [np.repeat(batch.column("row").to_numpy(), size), np.concatenate(keys), np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), size)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["row", "key", "held_out"])

        rows = self.encoded.where(F.octet_length("others") > 0).select("row", "others", "held_out")
        return rows.mapInArrow(run, "row long, key long, held_out boolean")

    def texts(self, training: bool) -> DataFrame:
        """``encoded`` with ``tail``: counts and emissions of the text's other words that training texts have."""
        rows, encoded = (x.where(~F.col("held_out")) if training else x for x in (self.rows, self.encoded))
        own = rows.join(self.table, "key").groupBy("row").agg(F.collect_list(F.struct("key", "n", *(f"s{s}" for s in range(self.k)))).alias("tail"))
        return encoded.join(own, "row", "left")

    def improve(self, number: int) -> None:
        """One pass of Baum-Welch over all training texts. What reaches the driver is bounded by known words times states."""
        k, n, v = self.k, len(self.model.emit), self.vocabulary
        found = self.scratch.write(expectations(self.texts(True), self.model), f"expected{number}")
        self.scratch.release()
        columns = [f"s{s}" for s in range(k)]
        some = found.where("kind <> 1").toArrow()
        kind, key = some.column("kind").to_numpy(), some.column("key").to_numpy()
        value = np.stack([some.column(c).to_numpy() for c in columns], axis=1)
        known, ends = np.zeros((n, k)), np.zeros((k + 1, k))
        del some
        known[key[kind == 0]], ends[key[kind == 2]] = value[kind == 0], value[kind == 2]
        rest = found.where("kind = 1").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns)).first()
        unseen = 0.5 / v.base_size
        gain = (1 - unseen) * (1 - SMOOTH) / np.maximum(known.sum(axis=0) + np.array(rest), 1e-9)
        move, start = ends[:k] + 0.1, ends[k] + 0.1
        emit = known * gain + SMOOTH * v.shares()[:, None]
        self.model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit, np.full(k, unseen))
        share = SMOOTH * (F.col("n") + 0.5) / v.base_size
        table = self.others.join(found.where("kind = 1").drop("kind"), "key", "left")
        self.table = self.scratch.write(table.select("key", "n", *((F.coalesce(c, F.lit(0.0)) * float(gain[s]) + share).cast("float").alias(c) for s, c in enumerate(columns))), f"emissions{number}")
        self.scratch.remove(f"expected{number}")
        if number:
            self.scratch.remove(f"emissions{number - 1}")
        self.scratch.release()


def score(docs: DataFrame, scratch: Scratch, passes: int = PASSES, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``held_out`` rows of ``docs`` (a boolean column) are not learned from. A null or empty text is its end
    alone. Repeated rows are counted and scored each; nulls in other columns play no part. With nothing to
    learn from, all words are unknown and all states alike.
    """
    counts = scratch.write(count_words(docs.where(~F.col("held_out"))), "counts")
    vocabulary = Vocabulary.of(counts, known)
    encoded = scratch.write(encode(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "encoded")
    scratch.release()
    trainer = Trainer(encoded, counts, vocabulary, scratch)
    for number in range(passes if vocabulary.tokens else 0):
        trainer.improve(number)
    sent, base = docs.sparkSession.sparkContext.broadcast(trainer.model), float(np.log10(vocabulary.base_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["doc_id", "held_out", "n_tokens", "n_known", "log_base"]
        for batch in batches:
            logs, more, seen = [], [], []
            for some in _held(_emissions(batch, sent.value)):
                logs.append(Windows.of(sent.value, [x[2] for x in some]).log)
            for places, others, tail in zip(batch.column("places"), batch.column("others"), batch.column("tail")):
                place, keys = np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(others.as_buffer(), np.uint64)
                times = np.bincount(place[place >= len(sent.value.emit)] - len(sent.value.emit), minlength=len(keys))
                n = np.zeros(len(keys))
                if len(keys) and tail.is_valid:
                    n[np.searchsorted(keys, tail.values.field("key").to_numpy().view(np.uint64))] = tail.values.field("n").to_numpy()
                more.append(float((times * np.log10(n + 0.5)).sum()))
                seen.append(int(times[n > 0].sum()))
            arrays = [*(batch.column(c) for c in keep), pa.array(more, pa.float64()), pa.array(seen, pa.int64()), pa.array(np.concatenate(logs))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "other_log", "other_known", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_base double, other_log double, other_known long, score double"
    found = trainer.texts(False).select("doc_id", "held_out", "n_tokens", "n_known", "log_base", "places", "others", "tail").mapInArrow(run, schema)
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("other_known")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("log_base") + F.col("other_log") - F.col("n_tokens") * base).alias("base_score"),
        "score",
    )


def op8_hmm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id"), 1).alias("held_out"))
    return score(docs, Scratch(spark, "op8"))
