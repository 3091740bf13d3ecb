"""Agreement of two partitions, corrected for chance: by expectation, and against seeded shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import below, draw, log_factorial
from .stored import keep, running, side

#: Terms of a series that one row stands for before it is spread.
STRETCH = 1 << 12


def _mutual(n: Column, x: Column, a: Column, b: Column) -> Column:
    return x / n * F.log(n * x / (a.cast("double") * b))


def expected_mutual_information(left: DataFrame, right: DataFrame, rows: int) -> float:
    """Mutual information expected of two partitions with the cluster sizes ``left`` and ``right`` (size, clusters), if
    members are dealt by chance: the mean over the hypergeometric distribution of every cell.

    Cells of equal sizes are alike, so only pairs of distinct sizes are summed, of which there are 2 n at most.
    The values of a cell from which its probability is told from nothing (20 times the root of the smaller size around the mean, beyond
    which it is below e^-800) are spread over rows in stretches, so a large cell is no task's alone.
    """
    n = F.lit(rows)
    pairs = left.select(F.col("size").alias("a"), F.col("clusters").alias("m")).join(right.select(F.col("size").alias("b"), F.col("clusters").alias("k")))
    wide = 20 * F.sqrt(F.least("a", "b").cast("double")) + 1
    mean = F.col("a").cast("double") * F.col("b") / n
    low = F.greatest(F.lit(1), F.col("a") + F.col("b") - n, F.floor(mean - wide))
    high = F.least(F.col("a"), F.col("b"), F.ceil(mean + wide))
    pairs = pairs.withColumns({"low": low.cast("long"), "high": high.cast("long")}).where("low <= high")
    spread = pairs.withColumn("from", F.explode(F.sequence("low", "high", F.lit(STRETCH).cast("long")))).repartition(F.col("a"), F.col("b"), F.col("from"))
    spread = spread.withColumn("x", F.explode(F.sequence("from", F.least(F.col("high"), F.col("from") + STRETCH - 1))))
    a, b, x, f = F.col("a"), F.col("b"), F.col("x"), log_factorial
    chance = F.exp(f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(x) - f(a - x) - f(b - x) - f(n + x - a - b))
    return spread.agg(F.sum(_mutual(n, x, a, b) * chance * F.col("m") * F.col("k"))).first()[0] or 0.0


def _sizes(cells: DataFrame, side: str) -> DataFrame:
    return cells.groupBy(side).agg(F.sum("n").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def _entropy(sizes: DataFrame, rows: int) -> float:
    p = F.col("size") / F.lit(rows)
    return sizes.agg(F.sum(-p * F.log(p) * F.col("clusters"))).first()[0] or 0.0


class Chance:
    """What agreement is measured against: the sizes of both partitions, which no shuffle changes."""

    def __init__(self, cells: DataFrame):
        """``cells``: a, b, n of the contingency table."""
        self.rows = cells.agg(F.sum("n")).first()[0] or 0
        left, right = keep(_sizes(cells, "a")), keep(_sizes(cells, "b"))
        self.parts = [s.agg(F.coalesce(F.sum("clusters"), F.lit(0))).first()[0] for s in (left, right)]
        # Both are one cluster, or both all single ones: they agree by necessity.
        self.trivial = self.rows < 2 or self.parts == [1, 1] or self.parts == [self.rows, self.rows]
        if self.trivial:
            return
        self.information = expected_mutual_information(left, right, self.rows)
        self.mean_entropy = (_entropy(left, self.rows) + _entropy(right, self.rows)) / 2
        two = lambda s: s.agg(F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2 * F.col("clusters"))).first()[0]
        self.pairs = (two(left), two(right), self.rows * (self.rows - 1) / 2)

    def scores(self, cells: DataFrame, *by: str) -> DataFrame:
        """(*by, ami, ari) of contingency tables of these sizes. ``cells``: *by, a, b, n."""
        if self.trivial:
            return cells.groupBy(*by).agg(F.lit(1.0).alias("ami"), F.lit(1.0).alias("ari"))
        total = {s: cells.groupBy(*by, s).agg(F.sum("n").alias(f"n_{s}")) for s in ("a", "b")}
        both = cells.join(total["a"], [*by, "a"]).join(total["b"], [*by, "b"])
        n = F.lit(self.rows)
        part = both.groupBy(*by).agg(F.sum(_mutual(n, F.col("n"), F.col("n_a"), F.col("n_b"))).alias("mi"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("cells"))
        spare = self.mean_entropy - self.information
        expected = self.pairs[0] * self.pairs[1] / self.pairs[2]
        most = (self.pairs[0] + self.pairs[1]) / 2 - expected
        ami = (F.col("mi") - self.information) / spare if abs(spare) >= 1e-12 else F.lit(0.0)
        ari = (F.col("cells") - expected) / most if most else F.lit(1.0)
        return part.select(*by, ami.alias("ami"), ari.alias("ari"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows that have both labels."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ``ami`` (by the mean of both entropies) and ``ari``, of two labels of the same rows."""
    cells = keep(contingency(rows, a, b))
    return Chance(cells).scores(cells.withColumn("_one", F.lit(1)), "_one").select("ami", "ari")


def shuffled(rows: DataFrame, key: str, label: str, times: int, seed: int) -> DataFrame:
    """(shuffle, key, label): the labels of ``rows`` dealt anew, ``times`` times.

    In every shuffle the rows are put in the order of a draw for their key, and the row that comes k-th gets the label of the
    k-th row by key. Places are counted in ranges, and draws depend on seed, shuffle and key alone, so the result is the same
    however the rows are partitioned. Keys are unique.
    """
    own = running(rows.select(F.col(key).alias("_key"), F.col(label).alias("_label")), F.col("_key"), _place=F.lit(1))
    own = keep(own)
    each = own.select("_key", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("shuffle")).withColumn("_at", draw(seed, F.col("shuffle"), F.col("_key")))
    placed = running(each, F.struct("shuffle", "_at", "_key"), _n=F.lit(1)).withColumn("_place", F.pmod(F.col("_n") - 1, F.lit(max(own.count(), 1))) + 1)
    return placed.select("shuffle", "_key", "_place").join(own.select("_place", "_label"), "_place").select("shuffle", F.col("_key").alias(key), F.col("_label").alias(label))


def against_shuffles(rows: DataFrame, key: str, cluster: str, label: str, times: int = 200, seed: int = 99) -> DataFrame:
    """One row: agreement of clusters with held-out labels, its mean over shuffled clusters, and how often chance does as well.

    ``rows`` without a label don't count. ``p_ami`` and ``p_ari`` are (1 + shuffles that reach the agreement seen) / (1 + times).
    """
    rows = keep(rows.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).select(key, cluster, label))
    cells = keep(contingency(rows, cluster, label))
    chance = Chance(cells)
    seen = chance.scores(cells.withColumn("_one", F.lit(1)), "_one").select("ami", "ari")
    dealt = shuffled(rows, key, cluster, times, seed).join(rows.select(key, label), key)
    table = dealt.groupBy("shuffle", F.col(cluster).alias("a"), F.col(label).alias("b")).agg(F.count("*").alias("n"))
    by = chance.scores(table, "shuffle").select(F.col("ami").alias("_ami"), F.col("ari").alias("_ari"))
    both = by.crossJoin(F.broadcast(seen))  # one row
    near = 1e-12  # sums in another order
    reach = lambda c: (1 + F.count_if(F.col(f"_{c}") >= F.col(c) - near)) / (times + 1)
    return both.groupBy("ami", "ari").agg(F.avg("_ami").alias("shuffled_ami"), F.avg("_ari").alias("shuffled_ari"), reach("ami").alias("p_ami"), reach("ari").alias("p_ari")).withColumn("rows", F.lit(chance.rows))


def random_pairs(spark: SparkSession, entities: DataFrame, pairs: int, seed: int) -> DataFrame:
    """(i, a, b): seeded pairs of ``entities`` (entity, unique); a pair of one entity with itself is left out, so there may be fewer."""
    numbered = keep(running(entities.select("entity"), F.col("entity"), _n=F.lit(1)))
    n = numbered.count()
    if n < 2:
        return spark.createDataFrame([], "i long").join(numbered.select(F.col("entity").alias("a"), F.col("entity").alias("b")))
    drawn = spark.range(pairs).select(F.col("id").alias("i"), (below(n, seed, F.col("id"), 0) + 1).alias("_a"), (below(n, seed, F.col("id"), 1) + 1).alias("_b")).where("_a <> _b")
    a, b = (numbered.select(F.col("_n").alias(f"_{c}"), F.col("entity").alias(c)) for c in ("a", "b"))
    return drawn.join(a, "_a").join(b, "_b").select("i", "a", "b")


def pair_similarity(pairs: DataFrame, sets: DataFrame, content: DataFrame) -> DataFrame:
    """(i, score): content of the terms that both of a pair have over that of all they have. ``sets``: entity, term.

    Only the sets of the pairs' entities are looked at.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    held = keep(sets.join(asked, "entity", "left_semi").join(side(content.select("term", "ic")), "term").select("entity", "term", "ic"))
    whole = held.groupBy("entity").agg(F.sum("ic").alias("whole"))
    a = pairs.select("i", F.col("a").alias("entity")).join(held, "entity").select("i", "term", "ic")
    b = pairs.select("i", F.col("b").alias("entity")).join(held, "entity").select("i", "term")
    both = a.join(side(b), ["i", "term"]).groupBy("i").agg(F.sum("ic").alias("both"))
    wa, wb = (whole.select(F.col("entity").alias(c), F.col("whole").alias(f"w{c}")) for c in ("a", "b"))
    out = pairs.join(wa, "a", "left").join(wb, "b", "left").join(both, "i", "left")
    shared, wa, wb = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("both", "wa", "wb"))
    return out.select("i", F.coalesce(F.try_divide(shared, wa + wb - shared), F.lit(0.0)).alias("score"))


def background(spark: SparkSession, sets: DataFrame | Callable[[DataFrame], DataFrame], content: DataFrame, pairs: int = 20_000, seed: int = 7, strong: float = 0.95, entities: DataFrame | None = None) -> DataFrame:
    """One row, pairs, strong and median: what similarity two entities have by chance, over at most ``pairs`` seeded pairs.

    ``sets`` may be a function that makes the sets of the entities it is given; ``entities`` are then all that have one.
    """
    drawn = keep(random_pairs(spark, sets.select("entity").distinct() if entities is None else entities, pairs, seed))
    if callable(sets):
        sets = sets(drawn.select(F.explode(F.array("a", "b")).alias("entity")).distinct())
    score = pair_similarity(drawn, sets, content)
    return score.agg(F.count("*").alias("pairs"), F.percentile("score", F.lit(strong)).alias("strong"), F.percentile("score", F.lit(0.5)).alias("median"))  # of ``pairs`` values
