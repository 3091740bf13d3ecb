"""Evidence queries: confidence, contradictions, gaps, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import star
from .registry import query


@query("ag_17", "WITH s AS (SELECT l_partkey AS subject, CASE l_returnflag WHEN 'N' THEN 70 WHEN 'A' THEN 50 ELSE 30 END + CASE WHEN l_quantity >= 25 THEN 10 ELSE 0 END - CASE WHEN l_linestatus = 'F' THEN 5 ELSE 0 END AS v, l_returnflag FROM lineitem) SELECT subject, greatest(max(least(v, 75)) - CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 15 ELSE 0 END, 5)::INT AS confidence FROM s GROUP BY 1")
def ag_17(spark, sf_dir):
    """Confidence: the best statement, capped, less a penalty for conflict, above a floor."""
    base = F.when(F.col("l_returnflag") == "N", 70).when(F.col("l_returnflag") == "A", 50).otherwise(30)
    value = base + F.when(F.col("l_quantity") >= 25, 10).otherwise(0) - F.when(F.col("l_linestatus") == "F", 5).otherwise(0)
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("subject")).agg(F.max(F.least(value, F.lit(75))).alias("best"), F.countDistinct("l_returnflag").alias("n"))
    return by.select("subject", F.greatest(F.col("best") - F.when(F.col("n") > 1, 15).otherwise(0), F.lit(5)).alias("confidence"))


@query("an_25", f"{star.with_views('ann')} SELECT term, count(*) FILTER (n > 0) AS present, count(*) FILTER (n = 0) AS absent, CASE WHEN count(*) FILTER (n = 0) = 0 OR count(*) FILTER (n > 0) = 0 THEN 'agreement' WHEN bool_or(iea) THEN 'context_difference' ELSE 'direct_contradiction' END AS verdict FROM ann GROUP BY 1")
def an_25(spark, sf_dir):
    """Statements on one term that oppose each other, and why that may be."""
    yes, no = F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 0)
    verdict = F.when((yes == 0) | (no == 0), "agreement").when(F.bool_or("iea"), "context_difference").otherwise("direct_contradiction")
    return star.annotations(spark, sf_dir).groupBy("term").agg(yes.alias("present"), no.alias("absent"), verdict.alias("verdict"))


@query("an_27", f"{star.with_views('ann')} SELECT CASE WHEN n = 0 THEN 'absent' WHEN m > 1 THEN 'frequency' ELSE 'present' END AS value_type, CASE WHEN iea THEN 'computational' ELSE 'cohort' END AS tier, count(*) AS statements FROM ann GROUP BY 1, 2")
def an_27(spark, sf_dir):
    """Statements by kind of value and tier of evidence."""
    kind = F.when(F.col("n") == 0, "absent").when(F.col("m") > 1, "frequency").otherwise("present")
    return star.annotations(spark, sf_dir).groupBy(kind.alias("value_type"), F.when(F.col("iea"), "computational").otherwise("cohort").alias("tier")).agg(F.count("*").alias("statements"))


@query("ag_12", "WITH k AS (SELECT c_custkey, count(o_orderkey) AS orders, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT gap, count(*) AS entities FROM (SELECT unnest(list_filter([CASE WHEN orders = 0 THEN 'no_orders' END, CASE WHEN open = 0 THEN 'no_open_order' END, CASE WHEN orders > 20 THEN 'crowded' END], lambda x: x IS NOT NULL)) AS gap FROM k) GROUP BY 1")
def ag_12(spark, sf_dir):
    """What is missing of each entity, from its counts."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = c.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    gaps = F.array_compact(F.array(F.when(F.col("orders") == 0, "no_orders"), F.when(F.col("open") == 0, "no_open_order"), F.when(F.col("orders") > 20, "crowded")))
    return k.select(F.explode(gaps).alias("gap")).groupBy("gap").agg(F.count("*").alias("entities"))


@query("ag_13", "WITH k AS (SELECT s_suppkey, count(l_orderkey) AS n, count(l_orderkey) FILTER (l_returnflag = 'N') AS e FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) SELECT s_suppkey, CASE WHEN e > 0 THEN 'ok' WHEN n > 0 THEN 'related_only' ELSE 'none_found' END AS status FROM k")
def ag_13(spark, sf_dir):
    """Coverage of each supplier."""
    k = table(spark, sf_dir, "supplier").select("s_suppkey").join(table(spark, sf_dir, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("e"))
    return k.select("s_suppkey", F.when(F.col("e") > 0, "ok").when(F.col("n") > 0, "related_only").otherwise("none_found").alias("status"))


@query("ag_21", "WITH p AS (SELECT DISTINCT c_name AS person, c_nationkey AS key FROM customer UNION SELECT DISTINCT s_name, s_nationkey FROM supplier) SELECT 'person_with_keys' AS conflict, count(*) AS n FROM (SELECT person FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'key_with_persons', count(*) FROM (SELECT key FROM p GROUP BY 1 HAVING count(*) > 1)")
def ag_21(spark, sf_dir):
    """People with two keys and keys of two people."""
    p = table(spark, sf_dir, "customer").select(F.col("c_name").alias("person"), F.col("c_nationkey").alias("key")).union(table(spark, sf_dir, "supplier").select("s_name", "s_nationkey")).distinct()
    many = lambda c, name: p.groupBy(c).agg(F.count("*").alias("k")).where("k > 1").agg(F.lit(name).alias("conflict"), F.count("*").alias("n"))
    return many("person", "person_with_keys").unionByName(many("key", "key_with_persons"))


@query("cx_15", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def cx_15(spark, sf_dir):
    """Distribution of held-out labels."""
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
