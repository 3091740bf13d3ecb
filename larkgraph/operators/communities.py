"""Communities by modularity, level by level until nothing moves; many runs side by side, and how stable they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import BITS, draw
from .stored import written

#: A gain, in units of weight or of modularity, that counts as one.
LEAST = 1e-12
#: As a power of two, the least share of the nodes that may move at once.
FEWEST = 3


def _two_ways(edges: DataFrame) -> DataFrame:
    """(run, a, b, weight) of every edge from both ends, parallel ones added; loops apart."""
    pairs = edges.where("a <> b").groupBy("run", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    return pairs.unionByName(pairs.select("run", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _pull(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, node, label, degree, own, to, pull): weight from each node to each community next to it, its own always among them, and to the one of its own name."""
    theirs = labels.select("run", F.col("node").alias("b"), F.col("label").alias("to"))
    near = both.join(theirs, ["run", "b"]).groupBy("run", F.col("a").alias("node"), "to").agg(F.sum("weight").alias("pull"))
    own = labels.select("run", "node", F.col("label").alias("to"), F.lit(0.0).alias("pull"))
    alone = labels.select("run", "node", F.col("node").alias("to"), F.lit(0.0).alias("pull"))
    near = near.unionByName(own).unionByName(alone).groupBy("run", "node", "to").agg(F.sum("pull").alias("pull"))
    return near.join(labels, ["run", "node"])


def _moves(pull: DataFrame, weights: dict, resolution: float) -> DataFrame:
    """(run, node, label, to, gain): the best community of every node that gains by going there; the least label among equals.

    One of a node's own name that nobody is in takes it alone.
    """
    total = pull.where("to = label").groupBy("run", F.col("label").alias("to")).agg(F.sum("degree").alias("total"))
    others = F.coalesce("total", F.lit(0.0)) - F.when(F.col("to") == F.col("label"), F.col("degree")).otherwise(0.0)
    worth = F.col("pull") - resolution * F.col("degree") * others / _of(weights)
    each = pull.join(total, ["run", "to"], "left").withColumn("worth", F.round(worth, 10))
    best = each.groupBy("run", "node", "label").agg(F.min(F.struct((-F.col("worth")).alias("w"), "to")).alias("best"), F.max(F.when(F.col("to") == F.col("label"), F.col("worth"))).alias("stay"))
    gain = -F.col("best.w") - F.col("stay")
    return best.where(gain > LEAST).select("run", "node", "label", "best.to", gain.alias("gain"))


def _of(weights: dict) -> Column:
    """The double weight of a row's run; there are few runs."""
    return F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("run")]


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch one community: each is the best for both that it touches. Their gains add up."""
    ends = moves.select("run", "node", "gain", F.explode(F.array("label", "to")).alias("c"))
    best = ends.groupBy("run", "c").agg(F.min(F.struct((-F.col("gain")).alias("g"), "node"))["node"].alias("node"))
    return moves.join(best.groupBy("run", "node").agg(F.count("*").alias("n")).where("n = 2").select("run", "node"), ["run", "node"])


def _level(both: DataFrame, nodes: DataFrame, inner: DataFrame, weights: dict, resolution: float, seed: int, most_rounds: int) -> DataFrame:
    """(run, node, label) after local moves from single nodes until none gains. ``nodes``: run, node, degree; ``inner``: run, node, weight."""
    loops = {r[0]: r[1] for r in inner.groupBy("run").agg(F.sum("weight")).collect()}
    proposed = nodes.select("run", "node", "degree", F.col("node").alias("label"))
    labels = pulls = None
    quality: dict = {}
    share, busy = {r: 1 for r in weights}, set(weights)  # one node in 2^share moves
    for k in range(most_rounds):
        pull = written(_pull(both, proposed.where(F.col("run").isin(*busy))))
        held = pull.where("to = label").groupBy("run", "label").agg(F.sum("pull").alias("inner"), F.sum("degree").alias("total"))
        worth = F.col("inner") / _of(weights) - resolution * F.pow(F.col("total") / _of(weights), F.lit(2.0))
        now = {r[0]: r[1] + 2 * loops.get(r[0], 0.0) / weights[r[0]] for r in held.groupBy("run").agg(F.sum(worth)).collect()}
        better = [r for r in busy if r not in quality or now[r] > quality[r] + LEAST]
        quality.update({r: now[r] for r in better})
        for r in busy:  # many may move at once as long as that helps; if not, fewer, and at last only such as can't disturb each other
            share[r] = max(1, min(share[r], FEWEST) - (share[r] > 1)) if r in better else share[r] + 1
        if set(better) == set(weights):
            labels, pulls = proposed, pull
        elif better:
            new = F.col("run").isin(*better)
            labels = written(proposed.where(new).unionByName(labels.where(~new)))
            pulls = written(pull.where(new).unionByName(pulls.where(~new)))
        moves = written(_moves(pulls.where(F.col("run").isin(*busy)), weights, resolution))
        busy = {r[0] for r in moves.select("run").distinct().collect()}
        if not busy:
            return written(labels.select("run", "node", "label"))
        few = [r for r in busy if share[r] > FEWEST]
        part = F.create_map(*(F.lit(x) for r in busy for x in (r, 1 << share[r])))[F.col("run")]
        chosen = moves.where(~F.col("run").isin(*few) & (draw(seed, F.col("run"), k, F.col("node")) % part == 0))
        chosen = chosen.unionByName(_apart(moves.where(F.col("run").isin(*few)))) if few else chosen
        step = labels.where(F.col("run").isin(*busy)).join(chosen.select("run", "node", "to"), ["run", "node"], "left")
        proposed = written(step.select("run", "node", "degree", F.coalesce("to", "label").alias("label")))
    raise RuntimeError(f"communities: nodes still move after {most_rounds} rounds")


def _leaves(both: DataFrame) -> DataFrame:
    """(run, node, hub) of the nodes with one neighbour; of two that have only each other, the greater."""
    one = both.groupBy("run", F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("b").alias("hub")).where("n = 1").select("run", "node", "hub")
    back = one.select("run", F.col("node").alias("hub"), F.col("hub").alias("_back"))
    return one.join(back, ["run", "hub"], "left").where("_back IS NULL OR node > hub").select("run", "node", "hub")


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 0, most_rounds: int = 500, most_levels: int = 50) -> DataFrame:
    """(run, node, label) by local moves that raise modularity, and the same again over the communities, until nothing moves.

    ``edges``: a, b, weight, and optionally run (whole number): runs are apart, and stepped side by side. A round moves half
    of the nodes, by a draw of seed, run, round and node, to the community that gains them most. As they move at
    the same time, the result is measured; a round that doesn't help is taken back, and the next one moves half as
    many, at last only nodes of which no two touch one community, whose gains add up. So modularity rises with
    every round that counts, and a level ends when no node has a gain. Up to a resolution of 1, a node with one neighbour gains most
    where that neighbour is, wherever it goes, so such nodes join it before the first level and are in no round. Raises where that takes too many rounds or levels.
    """
    if "run" not in edges.columns:
        edges = edges.withColumn("run", F.lit(0))
    both = written(_two_ways(edges.select("run", "a", "b", F.col("weight").cast("double").alias("weight"))))
    nodes = written(both.groupBy("run", F.col("a").alias("node")).agg(F.sum("weight").alias("degree")))
    weights = {r[0]: r[1] for r in nodes.groupBy("run").agg(F.sum("degree")).collect()}
    base = nodes.select("run", "node", F.col("node").alias("label"))
    if not weights:
        return base
    inner = written(nodes.select("run", "node", F.lit(0.0).alias("weight")).limit(0))
    for level in range(-1, most_levels):
        if level >= 0:
            labels = _level(both, nodes, inner, weights, resolution, seed + level, most_rounds)
        elif resolution <= 1:
            labels = written(nodes.join(_leaves(both), ["run", "node"], "left").select("run", "node", F.coalesce("hub", "node").alias("label")))
        else:
            continue
        base = written(base.join(labels.select("run", F.col("node").alias("label"), F.col("label").alias("_to")), ["run", "label"], "left").select("run", "node", F.coalesce("_to", "label").alias("label")))
        moved = {r[0] for r in labels.where("node <> label").select("run").distinct().collect()} if level >= 0 else set(weights)
        if not moved:
            return base
        some = F.col("run").isin(*moved)
        a, b = (labels.select("run", F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("a", "b"))
        joined = written(both.where(some).join(a, ["run", "a"]).join(b, ["run", "b"]).groupBy("run", "_a", "_b").agg(F.sum("weight").alias("weight")))
        within = joined.where("_a = _b").select("run", F.col("_a").alias("node"), (F.col("weight") / 2).alias("weight"))
        before = inner.where(some).join(labels, ["run", "node"]).select("run", F.col("label").alias("node"), "weight")
        inner = written(within.unionByName(before).groupBy("run", "node").agg(F.sum("weight").alias("weight")))
        nodes = written(nodes.where(some).join(labels, ["run", "node"]).groupBy("run", F.col("label").alias("node")).agg(F.sum("degree").alias("degree")))
        both = joined.where("_a <> _b").select("run", F.col("_a").alias("a"), F.col("_b").alias("b"), "weight")
        weights = {r: w for r, w in weights.items() if r in moved}
    raise RuntimeError(f"communities: still merging after {most_levels} levels")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(run, a, b, weight): the k heaviest partners of each node in each run, ties by the smaller partner, as edges a < b."""
    both = pairs.select("run", "a", "b", "weight").unionByName(pairs.select("run", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    place = F.row_number().over(Window.partitionBy("run", "a").orderBy(F.desc("weight"), "b"))
    best = both.withColumn("place", place).where(F.col("place") <= k)  # each task first leaves k of a node
    return best.select("run", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").distinct()


def stable_communities(pairs: DataFrame, k: int, runs: int = 20, fraction: float = 0.8, resolution: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(labels: node, label) and (clusters: label, size, edges, bridges, seed_jaccard, sample_jaccard) of a neighbour graph.

    ``pairs``: a, b, weight. The graph of the k nearest is partitioned once for the result, ``runs`` times more
    with other draws, and ``runs`` times over samples that hold each node with probability ``fraction``, whose graphs are made
    anew; all of these at once. A cluster's Jaccard is its best match in a run, in a sample among the sample's nodes,
    averaged over the runs that hold any of it.
    """
    every = pairs.select("a", "b", "weight", F.explode(F.sequence(F.lit(0), F.lit(2 * runs))).alias("run"))
    inside = lambda c: draw(seed, "sample", F.col("run"), F.col(c)) < F.lit(int(fraction * (1 << BITS)))
    every = every.where((F.col("run") <= runs) | (inside("a") & inside("b")))
    graph = written(nearest(every, k))
    found = written(communities(graph, resolution, seed))
    own = written(found.where("run = 0").select("node", F.col("label").alias("cluster")))
    size = own.groupBy("cluster").agg(F.count("*").alias("size"))
    # What a cluster and one of a run share; only nodes that the run holds count for the cluster there.
    shared = found.where("run > 0").join(own, "node").groupBy("run", "cluster", "label").agg(F.count("*").alias("both"))
    mine = shared.groupBy("run", "cluster").agg(F.sum("both").alias("mine"))
    theirs = found.where("run > 0").groupBy("run", "label").agg(F.count("*").alias("theirs"))
    match = shared.join(mine, ["run", "cluster"]).join(theirs, ["run", "label"]).withColumn("j", F.col("both") / (F.col("mine") + F.col("theirs") - F.col("both")))
    best = match.groupBy("run", "cluster").agg(F.max("j").alias("j"))
    part = lambda test: F.avg(F.when(test, F.col("j")))
    stable = best.groupBy("cluster").agg(part(F.col("run") <= runs).alias("seed_jaccard"), part(F.col("run") > runs).alias("sample_jaccard"))
    a, b = (own.select(F.col("node").alias(c), F.col("cluster").alias(f"c{c}")) for c in ("a", "b"))
    ends = graph.where("run = 0").join(a, "a").join(b, "b").select("ca", "cb")
    touched = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("cluster"), (F.col("ca") == F.col("cb")).alias("within"))
    edges = touched.groupBy("cluster").agg(F.count_if("within").alias("edges"), F.count_if(~F.col("within")).alias("bridges"))
    clusters = size.join(edges, "cluster").join(stable, "cluster", "left").withColumnRenamed("cluster", "label")
    return own.withColumnRenamed("cluster", "label"), clusters.select("label", "size", "edges", "bridges", "seed_jaccard", "sample_jaccard")
