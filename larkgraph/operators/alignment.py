"""Identity links between terminologies: cardinality, clusters without contradictions, and what other sources forbid.

Links are rows a, b, exact, conflict: two ids with a prefix, whether they are held to be one thing, and why not. A check
demotes links, it never drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .stored import keep, written

#: Conflicts by how often either side occurs, as fixed names.
MANY = {"1:n": "one_to_many", "n:1": "many_to_one", "n:n": "many_to_many"}


def prefix(id_: Column) -> Column:
    return F.substring_index(id_, ":", 1)


def demote(links: DataFrame, bad: Column, conflict: Column) -> DataFrame:
    """Exact links that are ``bad`` are exact no more; the reason joins those that they have."""
    hit = F.col("exact") & F.coalesce(bad, F.lit(False))
    reasons = F.array_join(F.array_union(F.split(F.coalesce("conflict", F.lit("")), ";"), F.array(conflict)), ";")
    return links.withColumns({"conflict": F.when(hit, F.ltrim(reasons, F.lit(";"))).otherwise(F.col("conflict")), "exact": F.col("exact") & ~hit})


def cardinality(links: DataFrame) -> DataFrame:
    """``links`` with ``cardinality`` among the exact ones of a pair of prefixes; those that aren't 1:1 are demoted."""
    to = F.when(F.col("exact"), prefix(F.col("b")))
    back = F.when(F.col("exact"), prefix(F.col("a")))
    asserted = links.where("exact")
    forward = asserted.groupBy("a", prefix(F.col("b")).alias("_to")).agg(F.countDistinct("b").alias("_f"))
    backward = asserted.groupBy("b", prefix(F.col("a")).alias("_back")).agg(F.countDistinct("a").alias("_b"))
    out = links.withColumns({"_to": to, "_back": back}).join(forward, ["a", "_to"], "left").join(backward, ["b", "_back"], "left")
    side = lambda c: F.when(F.col(c) > 1, "n").otherwise("1")
    out = out.withColumn("cardinality", F.when(F.col("exact"), F.concat_ws(":", side("_b"), side("_f"))))
    names = F.create_map(*(F.lit(x) for kv in MANY.items() for x in kv))
    reason = F.try_element_at(names, F.col("cardinality"))
    return demote(out, reason.isNotNull(), reason).select(*links.columns, "cardinality")


def accept(links: DataFrame, subject_prefix: str, conflict: str) -> DataFrame:
    """Declared aliases: links from ids of a prefix whose only conflict is ``conflict`` are exact again."""
    again = (prefix(F.col("a")) == subject_prefix) & (F.col("conflict") == conflict)
    return links.withColumns({"exact": F.col("exact") | F.coalesce(again, F.lit(False)), "conflict": F.when(again, None).otherwise(F.col("conflict"))})


def clusters(links: DataFrame) -> DataFrame:
    """(node, component) over the exact links."""
    return components(links.where("exact").select("a", "b"))


def _placed(links: DataFrame, named: DataFrame) -> DataFrame:
    return links.join(named.withColumnRenamed("node", "a"), "a", "left")


def consistent(links: DataFrame, multi: tuple[str, ...] = (), weakest: tuple[str, ...] = (), most_rounds: int = 50) -> DataFrame:
    """``links``, demoted until no cluster of exact ones holds two ids of a prefix (but of those in ``multi``).

    A round finds the clusters that do, and demotes their links at ids of the prefixes that occur twice; with
    ``weakest``, an order of prefixes, at ids of the weakest prefix in the cluster alone, whether it occurs twice or not, as it may be
    the bridge. Prefixes that aren't listed are weaker than all listed ones, by name. So links between strong
    terminologies outlive a disagreement about a weak one.
    """
    links, settled = written(links), None  # what is settled stands in clusters without a conflict, or is exact no more
    for _ in range(most_rounds):
        named = clusters(links).withColumn("prefix", prefix(F.col("node")))
        members = named.groupBy("component", "prefix").agg(F.count("*").alias("n")).where(~F.col("prefix").isin(*multi))
        twice = members.where("n > 1")
        if weakest:
            place = F.coalesce(F.array_position(F.array(*map(F.lit, weakest)), F.col("prefix")), F.lit(0))
            cut = members.join(twice.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min(F.struct(place.alias("place"), "prefix"))["prefix"].alias("prefix"))
        else:
            cut = twice
        cut = cut.groupBy("component").agg(F.collect_set("prefix").alias("_cut"))  # a cluster's prefixes: as many as terminologies
        rows = _placed(links, named.join(cut, "component")).withColumn("_was", F.col("exact"))
        bad = F.array_contains("_cut", prefix(F.col("a"))) | F.array_contains("_cut", prefix(F.col("b")))
        step = written(demote(rows, bad, F.lit("cluster_conflict")).select(*links.columns, "_was", (F.col("exact") & F.col("_cut").isNotNull()).alias("_open")))
        done = not step.where("_was AND NOT exact").limit(1).count()
        rest = (step if done else step.where("NOT _open OR _open IS NULL")).select(links.columns)
        settled = rest if settled is None else settled.unionByName(rest)
        if done:
            return settled
        links = step.where("_open").select(links.columns)
    raise RuntimeError(f"consistent: clusters still conflict after {most_rounds} rounds")


def against_background(links: DataFrame, background: DataFrame, apart: DataFrame, weakest: str, most_rounds: int = 50) -> DataFrame:
    """New ``links`` against what is published: ``background`` exact links (a, b), and pairs ``apart`` (a, b) that other sources
    relate as broader, narrower or related.

    First clusters of both are made consistent, where ids of the prefix ``weakest`` give way before those of all others; published
    links may lose there too, but only for the sake of the check. Then, until nothing changes, all new exact links in a
    cluster that would join two ids held apart are demoted as ``cross_source``. Comes back as the new links alone.
    """
    old = background.select("a", "b", F.lit(True).alias("exact"), F.lit(None).cast("string").alias("conflict"), F.lit(False).alias("_new"))
    every = links.select("a", "b", "exact", F.col("conflict").cast("string").alias("conflict"), F.lit(True).alias("_new")).unionByName(old)
    others = old.select(F.explode(F.array(prefix(F.col("a")), prefix(F.col("b")))).alias("p")).distinct().where(F.col("p") != weakest)
    order = (weakest, *sorted(r[0] for r in others.collect()))  # names of terminologies
    every = consistent(every, weakest=order)
    apart = apart.select(F.col("a").alias("_x"), F.col("b").alias("_y")).distinct()
    for _ in range(most_rounds):
        named = clusters(every)
        x, y = (named.select(F.col("node").alias(c), F.col("component").alias(k)) for c, k in (("_x", "component"), ("_y", "_other")))
        bad = apart.join(x, "_x").join(y, "_y").where("component = _other").select("component", F.lit(True).alias("_bad")).distinct()
        rows = _placed(every, named).join(bad, "component", "left")
        step = keep(demote(rows.withColumn("_was", F.col("exact")), F.col("_bad") & F.col("_new"), F.lit("cross_source")).select(*every.columns, "_was"))
        done = not step.where("_was AND NOT exact").limit(1).count()
        every = step.drop("_was")
        if done:
            return every.where("_new").drop("_new")
    raise RuntimeError(f"against_background: links still change after {most_rounds} rounds")


def contradictions(links: DataFrame, apart: DataFrame) -> DataFrame:
    """(a, b, component) of the pairs ``apart`` whose ids stand in one cluster of exact links."""
    named = clusters(links)
    a, b = (named.select(F.col("node").alias(c), F.col("component").alias(k)) for c, k in (("a", "component"), ("b", "_other")))
    return apart.select("a", "b").distinct().join(a, "a").join(b, "b").where("component = _other").select("a", "b", "component")
