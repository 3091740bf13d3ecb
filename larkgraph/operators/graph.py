"""Typed graphs: neighbourhoods, bounded traversal, paths, components, merged edges, facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import keep, written


def incident(edges: DataFrame) -> DataFrame:
    """(node, relation, direction, other): every edge seen from both ends."""
    out = edges.select(F.col("src").alias("node"), "relation", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), "relation", F.lit("in").alias("direction"), F.col("src").alias("other")))


@dataclass(frozen=True)
class Step:
    """One hop of a plan: a relation, its direction, and the prefixes that the reached ids may have."""

    relation: str
    direction: str = "out"
    kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    """A bounded traversal: at most 8 focus nodes and 4 steps, a page of at most 100 rows."""

    focus: tuple[str, ...]
    steps: tuple[Step, ...]
    limit: int = 100

    def __post_init__(self):
        if not 1 <= len(self.focus) <= 8:
            raise ValueError("a plan has 1 to 8 focus nodes")
        if not 1 <= len(self.steps) <= 4:
            raise ValueError("a plan has 1 to 4 steps")
        if not 1 <= self.limit <= 100:
            raise ValueError("a plan returns 1 to 100 rows")
        if any(s.direction not in ("in", "out") for s in self.steps):
            raise ValueError("a step goes in or out")


def traverse(edges: DataFrame, plan: Plan) -> DataFrame:
    """(focus, node) that the plan's steps reach, each pair once."""
    spark = edges.sparkSession
    focus = spark.range(1).select(F.explode(F.array(*map(F.lit, plan.focus))).alias("focus"))
    at = focus.select("focus", F.col("focus").alias("node"))
    for step in plan.steps:
        near, far = ("src", "dst") if step.direction == "out" else ("dst", "src")
        hop = edges.where(F.col("relation") == step.relation).select(F.col(near).alias("node"), F.col(far).alias("next"))
        at = at.join(hop, "node").select("focus", F.col("next").alias("node")).distinct()
        if step.kinds:
            at = at.where(F.substring_index("node", ":", 1).isin(*step.kinds))
    return at


def page(rows: DataFrame, plan: Plan, *order) -> DataFrame:
    """The first ``limit`` rows with ``truncated``: whether there are more."""
    some = rows.orderBy(*order).limit(plan.limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows at most
    marked = some.withColumns({"_place": place, "truncated": F.count("*").over(Window.partitionBy()) > plan.limit})
    return marked.where(F.col("_place") <= plan.limit).drop("_place")


def shortest_path(edges: DataFrame, start: str, goal: str, most_hops: int = 5, most_nodes: int | None = None) -> DataFrame:
    """(hop, node, relation) along one shortest undirected path; ties go to the least (previous node, relation).

    Breadth first: a frontier join and an anti join with what was seen, written between hops. What lies within half
    of the hops from the goal is found first; a node that is reached with so few hops left is kept only if it is among
    that, so hops through the hubs between the two stay small. ``edges`` may repeat. Raises when more than
    ``most_nodes`` were kept, if given. No rows if there is no path of ``most_hops`` hops or fewer.
    """
    spark = edges.sparkSession
    both = incident(edges).select("node", "relation", "other")
    near = [written(spark.range(1).select(F.lit(goal).alias("node")))]  # by hops from the goal, at most so many
    for _ in range(most_hops // 2):
        near.append(written(both.join(near[-1], "node", "left_semi").select(F.col("other").alias("node")).union(near[-1]).distinct()))
    seen = written(spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("relation")))
    for hop in range(1, most_hops + 1):
        if seen.where(F.col("node") == goal).limit(1).count():
            break
        frontier = seen.where(F.col("hop") == hop - 1).select("node")
        reached, left = both.join(frontier, "node"), most_hops - hop
        if left < len(near):
            reached = reached.join(near[left].withColumnRenamed("node", "other"), "other", "left_semi")
        reached = reached.groupBy(F.col("other").alias("node")).agg(F.min(F.struct(F.col("node").alias("via"), "relation")).alias("best"))
        new = reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "best.via", "best.relation")
        seen = written(seen.unionByName(new))
        if most_nodes is not None and seen.count() > most_nodes:
            raise RuntimeError(f"shortest_path: more than {most_nodes} nodes")
    back = written(seen.where(F.col("node") == goal))
    path = back
    for _ in range(most_hops):
        back = seen.join(back.select(F.col("via").alias("node")), "node", "left_semi")
        path = path.unionByName(back)
    return path.select("hop", "node", "relation")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the least node each node of ``edges`` (a, b) can reach.

    Every node joins its neighbour of the most neighbours, the least of these, unless it has more itself; what joined becomes
    one node, and the edges left between such nodes are the next round's. Each round at least halves the nodes, and where
    many nodes hang on few, as copies on their source, the first leaves next to nothing.
    """
    pairs = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    left = written(pairs.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = None
    for _ in range(most_rounds):
        if labels is not None and not left.limit(1).count():
            break
        size = left.groupBy(F.col("a").alias("b")).agg((-F.count("*")).alias("less"))
        best = left.join(size, "b").groupBy(F.col("a").alias("node")).agg(F.min(F.struct("less", F.col("b").alias("node"))).alias("best"), (-F.count("*")).alias("less"))
        step = written(best.select("node", F.least("best", F.struct("less", "node"))["node"].alias("top")))
        for _ in range(most_rounds):
            above = step.where("node <> top").select(F.col("node").alias("top"), F.col("top").alias("up"))
            step = written(step.join(above, "top", "left").select("node", F.coalesce("up", "top").alias("top"), F.col("up").isNotNull().alias("moved")))
            if not step.where("moved").limit(1).count():
                break
        else:
            raise RuntimeError(f"components: labels still change after {most_rounds} rounds")
        step = step.select("node", "top")
        a, b = (step.select(F.col("node").alias(c), F.col("top").alias(k)) for c, k in (("a", "x"), ("b", "y")))
        left = written(left.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        labels = step if labels is None else labels.join(step.select(F.col("node").alias("top"), F.col("top").alias("up")), "top", "left").select("node", F.coalesce("up", "top").alias("top"))
    else:
        raise RuntimeError(f"components: labels still change after {most_rounds} rounds")
    labels = written(labels.unionByName(pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("top")).distinct().join(labels, "node", "left_anti")))
    return labels.join(labels.groupBy("top").agg(F.min("node").alias("component")), "top").select("node", "component")


def merge_edges(edges: DataFrame, key: list[str], level: str, order: list[str], records: str) -> DataFrame:
    """One row for each key: the attributes of the strongest level (first in ``order`` among equals) and all records."""
    rest = [c for c in edges.columns if c not in (*key, records)]
    best = F.min_by(F.struct(*rest), F.struct(F.col(level), *(F.col(c) for c in order)))
    return edges.groupBy(*key).agg(best.alias("best"), F.array_sort(F.collect_set(records)).alias(records)).select(*key, "best.*", records)


def facets(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(facet, value, n): counts of each facet under the filters of all the others, in one pass over the rows."""
    counted = []
    for name in filters:
        others = F.lit(True)
        for other, test in filters.items():
            if other != name:
                others = others & test
        counted.append(F.when(others, F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))))
    each = rows.select(F.explode(F.array_compact(F.array(*counted))).alias("f"))
    return each.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def suggestions(edges: DataFrame) -> DataFrame:
    """(kind, relation, direction, other_kind, targets, edges, witness): what can be asked of each kind of node."""
    kind = lambda c: F.substring_index(c, ":", 1)
    seen = incident(edges).select(kind("node").alias("kind"), "relation", "direction", kind("other").alias("other_kind"), "other")
    return seen.groupBy("kind", "relation", "direction", "other_kind").agg(F.countDistinct("other").alias("targets"), F.count("*").alias("edges"), F.min("other").alias("witness"))
