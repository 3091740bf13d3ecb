"""Hierarchy queries: closure, content, reductions, subtrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ontology as o
from ..operators.stored import side, written
from ..sources import star
from .registry import query


def closed(spark, sf_dir):
    return o.closure(star.hierarchy(spark, sf_dir))


def present(spark, sf_dir):
    return star.annotations(spark, sf_dir).where("n > 0")


def annotated(spark, sf_dir):
    """(entity, term) of what is present, written, as it is read several times."""
    return written(present(spark, sf_dir).select("entity", "term"))


@query("gr_01", f"{star.with_views('isa', 'clo')} SELECT node, ancestor FROM clo")
def gr_01(spark, sf_dir):
    """Reflexive-transitive closure of the part hierarchy."""
    return closed(spark, sf_dir)


@query("gr_02", f"{star.with_views('isa', 'clo')} SELECT ancestor AS term, count(*) AS descendants FROM clo GROUP BY 1")
def gr_02(spark, sf_dir):
    """Descendants of each term, itself included."""
    return closed(spark, sf_dir).groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("descendants"))


@query("ag_07", f"{star.with_views('isa', 'clo', 'ann', 'ic')} SELECT term, round(ic, 6) + 0.0 AS ic FROM ic")
def ag_07(spark, sf_dir):
    """Information content of every term over annotated entities."""
    return o.information_content(annotated(spark, sf_dir), closed(spark, sf_dir)).select("term", (F.round("ic", 6) + 0.0).alias("ic"))


@query("ag_08", f"{star.with_views('isa', 'clo', 'ann', 'ic')} SELECT term, CASE WHEN size > 0 THEN round(-ln(size / entities), 6) + 0.0 ELSE 0.0 END AS ic FROM ic")
def ag_08(spark, sf_dir):
    """Process content: terms that annotate nothing count 0."""
    annotations, closure = annotated(spark, sf_dir), closed(spark, sf_dir)
    n = annotations.agg(F.countDistinct("entity").alias("entities"))
    rows = closure.select(F.col("ancestor").alias("term")).distinct().join(side(o.annotated_sizes(annotations, closure)), "term", "left").crossJoin(F.broadcast(n))
    return rows.select("term", F.coalesce(F.round(-F.log(F.col("size") / F.col("entities")), 6) + 0.0, F.lit(0.0)).alias("ic"))


@query("st_02", f"""{star.with_views('isa', 'clo', 'ann')},
    bag AS (SELECT entity % 50 AS grp, term FROM ann WHERE n > 0 UNION SELECT entity % 50, ancestor FROM ann JOIN clo ON clo.node = ann.term WHERE n > 0 AND (entity + m) % 7 = 0)
    SELECT grp, term FROM bag b WHERE NOT EXISTS (SELECT 1 FROM bag c JOIN clo ON clo.node = c.term WHERE c.grp = b.grp AND clo.ancestor = b.term AND clo.node <> b.term)""")
def st_02(spark, sf_dir):
    """Most specific terms of each group's set."""
    annotations, closure = present(spark, sf_dir), closed(spark, sf_dir)
    own = annotations.select((F.col("entity") % 50).alias("grp"), "term")
    up = annotations.where((F.col("entity") + F.col("m")) % 7 == 0).join(closure, F.col("term") == F.col("node")).select((F.col("entity") % 50).alias("grp"), F.col("ancestor").alias("term"))
    return o.most_specific(own.union(up).distinct(), closure, "grp", "term")


@query("fl_09", f"{star.with_views('isa', 'clo')} SELECT p_partkey, p_name FROM part WHERE 'P:' || p_partkey IN (SELECT node FROM clo WHERE ancestor = 'B:Brand#11')")
def fl_09(spark, sf_dir):
    """Parts below one branch of the hierarchy."""
    below = closed(spark, sf_dir).where("ancestor = 'B:Brand#11'").select("node")
    parts = star.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.join(below, F.concat(F.lit("P:"), "p_partkey") == F.col("node"), "left_semi")


@query("cx_16", f"{star.with_views('isa', 'clo', 'ann')} SELECT ancestor AS term, count(DISTINCT entity) AS entities FROM ann JOIN clo ON clo.node = ann.term WHERE n > 0 AND ancestor LIKE 'Y:%' GROUP BY 1")
def cx_16(spark, sf_dir):
    """Entities under each type."""
    return o.annotated_sizes(annotated(spark, sf_dir), closed(spark, sf_dir).where("ancestor LIKE 'Y:%'")).select("term", F.col("size").alias("entities"))


@query("jn_03", """WITH RECURSIVE alias AS (SELECT p_partkey AS id, (p_partkey // 3) * 2 AS target FROM part WHERE p_partkey % 3 <> 0),
    walk AS (SELECT id, target AS spot, 1 AS hop FROM alias UNION ALL SELECT walk.id, alias.target, hop + 1 FROM walk JOIN alias ON alias.id = walk.spot WHERE hop < 32)
    SELECT id, arg_max(spot, hop) AS canonical FROM walk GROUP BY id""")
def jn_03(spark, sf_dir):
    """Canonical id of replaced ids: part keys not divisible by 3 are replaced by lesser ones."""
    parts = star.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    return o.canonical(parts.select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3 * 2").alias("target")))


@query("gr_15", f"""{star.with_views('isa', 'clo', 'ann')},
    seed AS (SELECT DISTINCT node FROM clo WHERE ancestor = 'B:Brand#11'), ent AS (SELECT DISTINCT entity FROM ann JOIN seed ON node = term WHERE n > 0)
    SELECT entity, count(DISTINCT ancestor) AS terms FROM ann JOIN ent USING (entity) JOIN clo ON clo.node = term WHERE n > 0 GROUP BY 1""")
def gr_15(spark, sf_dir):
    """Slice: entities annotated below a seed, and how many terms their annotations reach."""
    annotations, closure = present(spark, sf_dir), closed(spark, sf_dir)
    seed = closure.where("ancestor = 'B:Brand#11'").select(F.col("node").alias("term"))
    entities = annotations.join(seed, "term", "left_semi").select("entity").distinct()
    reached = annotations.join(entities, "entity", "left_semi").join(closure, F.col("term") == F.col("node"))
    return reached.groupBy("entity").agg(F.countDistinct("ancestor").alias("terms"))
