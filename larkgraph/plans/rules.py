"""Derived connections and fair selections from neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budgets, rules
from ..operators.stored import written
from ..session import table
from ..sources.star import SQL, hierarchy
from .registry import query

LINES = "l AS MATERIALIZED (SELECT 'C:' || o_custkey AS c, 'P:' || l_partkey AS p, 'S:' || l_suppkey AS s, 'O:' || l_orderkey AS o, 'T:' || p_type AS t, l_returnflag AS flag, l_linenumber AS line, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
EACH = (
    ("has_phenotype", "c", "p", "flag <> 'R'"),
    ("has_causal_gene", "c", "s", "flag = 'R' AND line = 1 AND q >= 10"),
    ("targets", "t", "s", "line = 2 AND q >= 49"),
    ("serves_gene", "o", "s", "line = 7 AND q >= 45"),
    ("models_gene", "p", "s", "line = 6 AND q >= 45"),
)
FACTS = f"{LINES}, f0 AS (" + " UNION ".join(f"SELECT {a} AS x, '{r}' AS r, {b} AS y FROM l WHERE {w}" for r, a, b, w in EACH) + " UNION SELECT 'S:' || s_suppkey, 'in_pathway', 'N:' || s_nationkey FROM supplier), f AS MATERIALIZED (SELECT x || '|' || r || '|' || y AS id, x, r, y FROM f0)"


def facts(spark, sf_dir):
    """(id, subject, relation, object): customers as conditions, suppliers as genes, their nations as pathways."""
    pid = lambda p, c: F.concat(F.lit(p), c)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(pid("C:", "o_custkey").alias("c"), pid("P:", "l_partkey").alias("p"), pid("S:", "l_suppkey").alias("s"), pid("O:", "l_orderkey").alias("o"), pid("T:", "p_type").alias("t"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"))
    each = F.array_compact(F.array(*(F.when(F.expr(w), F.struct(F.col(a).alias("subject"), F.lit(r).alias("relation"), F.col(b).alias("object"))) for r, a, b, w in EACH)))
    out = lines.select(F.explode(each).alias("f")).select("f.*")
    out = out.unionByName(table(spark, sf_dir, "supplier").select(pid("S:", "s_suppkey").alias("subject"), F.lit("in_pathway").alias("relation"), pid("N:", "s_nationkey").alias("object"))).distinct()
    return out.withColumn("id", F.concat_ws("|", "subject", "relation", "object"))


def _gene(name, relation):
    return f"SELECT '{name}' AS rule, a.x AS subject, b.x AS object, [a.id, b.id] AS w FROM f a JOIN f b ON b.y = a.y AND b.r = '{relation}' AND b.x <> a.x WHERE a.r = 'has_causal_gene' AND a.x IN (SELECT x FROM seeds)"


@query("gr_13", f"""WITH {FACTS}, seeds AS (SELECT 'C:' || c_custkey AS x FROM customer WHERE c_custkey < 8),
    rare AS (SELECT y FROM f WHERE r = 'has_phenotype' GROUP BY y HAVING count(DISTINCT x) * 10 <= (SELECT count(DISTINCT x) FROM f WHERE r = 'has_phenotype')),
    h AS MATERIALIZED (SELECT id, x, y FROM f WHERE r = 'has_phenotype' AND y IN (SELECT y FROM rare)),
    ab AS MATERIALIZED (SELECT a.x AS s, b.x AS o, a.y AS p, a.id AS ai, b.id AS bi FROM h a JOIN h b ON a.y = b.y AND a.x <> b.x WHERE a.x IN (SELECT x FROM seeds)),
    c AS (SELECT 'shared_phenotypes' AS rule, m.s AS subject, m.o AS object, [m.ai, m.bi, n.ai, n.bi] AS w FROM ab m JOIN ab n ON m.s = n.s AND m.o = n.o AND m.p < n.p
        UNION ALL {_gene('shared_gene', 'has_causal_gene')} UNION ALL {_gene('drug_target', 'targets')} UNION ALL {_gene('community_via_gene', 'serves_gene')} UNION ALL {_gene('asset_via_gene', 'models_gene')}
        UNION ALL SELECT 'shared_pathway', a.x, d.x, [a.id, b.id, c.id, d.id] FROM f a JOIN f b ON b.x = a.y AND b.r = 'in_pathway' JOIN f c ON c.y = b.y AND c.r = 'in_pathway' JOIN f d ON d.y = c.x AND d.r = 'has_causal_gene' AND d.x <> a.x WHERE a.r = 'has_causal_gene' AND a.x IN (SELECT x FROM seeds))
    SELECT rule, subject, object, count(*) AS paths, array_to_string(min(w), ' > ') AS witness FROM c GROUP BY 1, 2, 3""")
def gr_13(spark, sf_dir):
    """Six ways to be connected with eight conditions, each pair with its least witness and the number of its paths."""
    rows = written(facts(spark, sf_dir), "relation")
    rows = rows.where("relation <> 'has_phenotype'").unionByName(rules.distinctive(rows, "has_phenotype", "has_phenotype"))
    seeds = table(spark, sf_dir, "customer").where("c_custkey < 8").select(F.concat(F.lit("C:"), "c_custkey").alias("node"))
    out = rules.derive(rows, rules.connections(), seeds)
    return out.select("rule", "subject", "object", "paths", F.array_join("witness", " > ").alias("witness"))


@query("gr_13_closure", f"WITH RECURSIVE {SQL['isa']}, c AS (SELECT e.c AS node, e.p AS ancestor, 1 AS hops FROM isa UNION SELECT c.node, e.p, hops + 1 FROM c JOIN isa ON e.c = c.ancestor) SELECT node AS subject, ancestor AS object, min(hops)::INT AS hops FROM c GROUP BY 1, 2")
def gr_13_closure(spark, sf_dir):
    """A rule that feeds on what it derives: whatever stands above a part, and over how many edges."""
    edges = hierarchy(spark, sf_dir).select(F.col("child").alias("subject"), F.lit("is_a").alias("relation"), F.col("parent").alias("object"))
    edges = edges.withColumn("id", F.concat_ws("|", "subject", "object"))
    above = [rules.Rule("direct", ("x", "within", "y"), (("x", "is_a", "y"),)), rules.Rule("further", ("x", "within", "z"), (("x", "is_a", "y"), ("y", "within", "z")))]
    return rules.derive(edges, above).select("subject", "object", F.size("witness").alias("hops"))


@query("rk_10", """WITH RECURSIVE e AS (SELECT 'N:' || c_nationkey AS n, c_nationkey AS seed, 'C:' || c_custkey AS c, 'O:' || o_orderkey AS o, o_orderkey AS place FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey < 8),
    p AS (SELECT seed, place, list('P:' || l_partkey) AS parts FROM e JOIN lineitem ON l_orderkey = place WHERE l_linenumber <= place % 4 GROUP BY 1, 2),
    q AS (SELECT seed, place, list_distinct([n, c, o] || coalesce(parts, [])) AS nodes, list_distinct([c || '>' || n, o || '>' || c] || list_transform(coalesce(parts, []), lambda x: o || '>' || x)) AS edges, row_number() OVER (PARTITION BY seed ORDER BY place) AS round FROM e LEFT JOIN p USING (seed, place)),
    k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round, seed) AS i FROM q),
    s AS (SELECT 0::BIGINT AS i, list_transform(range(8), lambda x: 'N:' || x) AS nodes, []::VARCHAR[] AS edges, false AS taken
        UNION ALL SELECT k.i, CASE WHEN ok THEN all_nodes ELSE nodes END, CASE WHEN ok THEN all_edges ELSE edges END, ok
        FROM (SELECT s.i + 1 AS i, s.nodes, s.edges, list_distinct(s.nodes || k.nodes) AS all_nodes, list_distinct(s.edges || k.edges) AS all_edges, len(list_distinct(s.nodes || k.nodes)) <= 100 AND len(list_distinct(s.edges || k.edges)) <= 160 AS ok FROM s JOIN k ON k.i = s.i + 1) AS k)
    SELECT seed, place, round FROM s JOIN k USING (i) WHERE taken""")
def rk_10(spark, sf_dir):
    """Orders of eight nations with some of their parts, taken in turn until 100 nodes and 160 edges are reached."""
    n, c, o = (F.concat(F.lit(p), k) for p, k in (("N:", "c_nationkey"), ("C:", "c_custkey"), ("O:", "o_orderkey")))
    orders = table(spark, sf_dir, "customer").where("c_nationkey < 8").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    orders = orders.select(F.col("c_nationkey").alias("seed"), F.col("o_orderkey").alias("place"), n.alias("n"), c.alias("c"), o.alias("o"))
    some = table(spark, sf_dir, "lineitem").where("l_linenumber <= l_orderkey % 4").groupBy(F.col("l_orderkey").alias("place")).agg(F.collect_list(F.concat(F.lit("P:"), "l_partkey")).alias("parts"))
    rows = orders.join(some, "place", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    item = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), id_.alias("id"))
    edge = lambda a, b: F.concat(a, F.lit(">"), b)
    fixed = F.array(*(item("node", F.col(x)) for x in "nco"), item("edge", edge(F.col("c"), F.col("n"))), item("edge", edge(F.col("o"), F.col("c"))))
    items = F.concat(fixed, F.transform("parts", lambda p: item("node", p)), F.transform("parts", lambda p: item("edge", edge(F.col("o"), p))))
    seeds = [("node", f"N:{i}") for i in range(8)]
    return budgets.round_robin(rows.select("seed", "place", items.alias("items")), {"node": 100, "edge": 160}, seeds)
