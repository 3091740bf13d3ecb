"""The concepts of the knowledge graph as views over the star schema.

Entities are customers; a term is a part they bought; parts stand in a hierarchy of kind, brand and type;
suppliers stand for genes; nations and regions for places; orders for studies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import spread
from ..session import table

#: The same views in DuckDB SQL, for oracles.
SQL = {
    "ann": "ann AS (SELECT o_custkey AS entity, 'P:' || l_partkey AS term, count(*) FILTER (l_returnflag <> 'R') AS n, count(*) AS m, bool_and(l_linestatus = 'F') AS iea FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)",
    "isa": "isa AS (SELECT DISTINCT unnest([{'c': 'P:' || p_partkey, 'p': 'T:' || p_brand || '/' || p_type}, {'c': 'T:' || p_brand || '/' || p_type, 'p': 'B:' || p_brand}, {'c': 'T:' || p_brand || '/' || p_type, 'p': 'Y:' || p_type}, {'c': 'B:' || p_brand, 'p': 'ROOT'}, {'c': 'Y:' || p_type, 'p': 'ROOT'}]) AS e FROM part)",
    "clo": "clo AS (SELECT e.c AS node, e.c AS ancestor FROM isa UNION SELECT 'ROOT', 'ROOT' UNION SELECT clo.node, e.p FROM clo JOIN isa ON e.c = clo.ancestor)",
    "ic": "ic AS (SELECT t.term, -ln(coalesce(s.size / n.n, 1.0 / (n.n + 1))) AS ic, coalesce(s.size, 0) AS size, n.n AS entities FROM (SELECT DISTINCT ancestor AS term FROM clo) t LEFT JOIN (SELECT ancestor AS term, count(DISTINCT entity)::DOUBLE AS size FROM ann JOIN clo ON clo.node = ann.term WHERE ann.n > 0 GROUP BY 1) s USING (term) CROSS JOIN (SELECT count(DISTINCT entity) AS n FROM ann WHERE ann.n > 0) n)",
    "edge": "edge AS (SELECT DISTINCT * FROM (SELECT 'C:' || c_custkey AS src, 'located_in' AS relation, 'N:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'located_in', 'N:' || s_nationkey FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'part_of', 'R:' || n_regionkey FROM nation UNION ALL SELECT 'O:' || o_orderkey, 'placed_by', 'C:' || o_custkey FROM orders UNION ALL SELECT 'O:' || l_orderkey, 'contains', 'P:' || l_partkey FROM lineitem UNION ALL SELECT 'S:' || l_suppkey, 'offers', 'P:' || l_partkey FROM lineitem))",
}


def with_views(*names: str) -> str:
    """WITH RECURSIVE and the named views, for the head of an oracle."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, term, n, m, iea): lines not returned, all lines, and whether all were computed (status F)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = lines.count()
    lines = lines.select("l_orderkey", "l_partkey", (F.col("l_returnflag") != "R").alias("kept"), (F.col("l_linestatus") == "F").alias("f"))
    both = spread(lines, n, "l_orderkey").join(spread(orders.select("o_orderkey", "o_custkey"), n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = spread(both.select("o_custkey", "l_partkey", "kept", "f"), n, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey")
    rows = rows.agg(F.count_if("kept").alias("n"), F.count("*").alias("m"), F.bool_and("f").alias("iea"))
    return rows.select(F.col("o_custkey").alias("entity"), F.concat(F.lit("P:"), "l_partkey").alias("term"), "n", "m", "iea")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): part, kind (brand and type), brand or type, root."""
    kind = F.concat(F.lit("T:"), "p_brand", F.lit("/"), "p_type")
    brand, type_ = F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("Y:"), "p_type")
    pairs = [(F.concat(F.lit("P:"), "p_partkey"), kind), (kind, brand), (kind, type_), (brand, F.lit("ROOT")), (type_, F.lit("ROOT"))]
    rows = F.array(*(F.struct(a.alias("child"), b.alias("parent")) for a, b in pairs))
    return table(spark, sf_dir, "part").select(F.explode(rows).alias("e")).select("e.*").distinct()


def graph(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """(src, relation, dst): typed edges between prefixed ids, distinct unless those of several lines may repeat."""

    def edges(name: str, src: str, a: str, relation: str, dst: str, b: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(src), a).alias("src"), F.lit(relation).alias("relation"), F.concat(F.lit(dst), b).alias("dst"))

    # Keys are unique in all tables but lineitem, whose pairs repeat.
    keyed = (
        ("customer", "C:", "c_custkey", "located_in", "N:", "c_nationkey"),
        ("supplier", "S:", "s_suppkey", "located_in", "N:", "s_nationkey"),
        ("nation", "N:", "n_nationkey", "part_of", "R:", "n_regionkey"),
        ("orders", "O:", "o_orderkey", "placed_by", "C:", "o_custkey"),
    )
    out = edges("lineitem", "O:", "l_orderkey", "contains", "P:", "l_partkey").unionByName(edges("lineitem", "S:", "l_suppkey", "offers", "P:", "l_partkey"))
    out = out if repeats else out.distinct()
    for k in keyed:
        out = out.unionByName(edges(*k))
    return out
