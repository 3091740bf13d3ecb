"""Hierarchies: closure, information content, reductions, canonical ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import keep, side, spread, written


def closure(edges: DataFrame, most_rounds: int = 32) -> DataFrame:
    """Reflexive-transitive closure (node, ancestor) of ``edges`` (child, parent).

    In a round, only pairs that the last one found are lengthened, by all that is known; paths double in length,
    so the rounds are the logarithm of the depth, and cycles end too.
    """
    pairs = keep(edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    nodes = pairs.select("node").union(pairs.select("ancestor")).distinct()
    strict = new = pairs.where("node <> ancestor")
    for _ in range(most_rounds):
        further = strict.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = new.join(side(further), "ancestor").select("node", F.col("further").alias("ancestor")).where("node <> ancestor").distinct()
        new = keep(longer.join(side(strict), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return strict.unionByName(nodes.select("node", F.col("node").alias("ancestor")))
        strict = strict.unionByName(new)
    raise RuntimeError(f"closure: still growing after {most_rounds} rounds")


def annotated_sizes(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, size): distinct entities annotated with each term or one below it. ``annotations``: entity, term; read twice.

    Terms with nothing below count their own entities. The others' ancestors are the same for very many terms, so
    terms of equal ancestors are one class; entities are dealt once, with the classes that they have, and only there are
    classes spelt out, so that what is shuffled are the annotations and not their ancestors.
    """
    n = annotations.count()
    inner = written(closed.where("node <> ancestor").select("ancestor").distinct())
    inner = side(inner, inner.count())
    up = closed.where("node <> ancestor").unionByName(closed.where("node = ancestor").join(inner, "ancestor", "left_semi").select("node", "ancestor"))
    sets = written(up.groupBy("node").agg(F.array_sort(F.collect_set("ancestor")).alias("up")))
    classes = written(sets.select("up").distinct().withColumn("class", F.monotonically_increasing_id()))
    classes = side(classes, classes.count())
    named = sets.join(classes, "up").select(F.col("node").alias("term"), "class")
    rows = spread(annotations.select("entity", "term"), n, "term")
    leaves = closed.where("node = ancestor").join(inner, "ancestor", "left_anti").select(F.col("node").alias("term")).distinct()
    own = rows.join(side(leaves), "term", "left_semi").groupBy("term").agg(F.countDistinct("entity").alias("size"))
    held = spread(rows.join(side(named), "term").select("entity", "class"), n, "entity").distinct()
    held = held.join(classes, "class").select("entity", F.explode("up").alias("term")).distinct()
    return own.unionByName(held.groupBy("term").agg(F.count("entity").alias("size")))


def information_content(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, ic) for every term: -ln(size / N); one that annotates nothing counts as one of N + 1."""
    n = annotations.agg(F.countDistinct("entity").alias("entities"))
    terms = closed.select(F.col("ancestor").alias("term")).distinct()
    sizes = terms.join(side(annotated_sizes(annotations, closed)), "term", "left").crossJoin(F.broadcast(n))  # n is one row
    share = F.coalesce(F.col("size") / F.col("entities"), 1.0 / (F.col("entities") + 1))
    return sizes.select("term", (-F.log(share)).alias("ic"))


def most_specific(sets: DataFrame, closed: DataFrame, group: str, term: str) -> DataFrame:
    """Rows of ``sets`` whose term isn't a proper ancestor of another term of the same group."""
    strict = closed.where("node <> ancestor")
    above = sets.join(strict, sets[term] == strict["node"]).select(F.col(group).alias("g"), F.col("ancestor").alias("t")).distinct()
    return sets.join(above, (F.col(group) == F.col("g")) & (F.col(term) == F.col("t")), "left_anti")


def canonical(aliases: DataFrame, hops: int = 32) -> DataFrame:
    """(id, canonical) after at most ``hops`` replacements. ``aliases``: id, target."""
    now = aliases.groupBy("id").agg(F.min("target").alias("canonical"))
    done = 1
    while done < hops:
        ahead = now.select(F.col("id").alias("canonical"), F.col("canonical").alias("further"))
        step = keep(now.join(ahead, "canonical", "left").select("id", F.coalesce("further", "canonical").alias("canonical")))
        changed = step.join(now.select("id", F.col("canonical").alias("old")), "id").where("canonical <> old").limit(1).count()
        now, done = step, 2 * done
        if not changed:
            break
    return now
