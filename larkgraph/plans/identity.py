"""Identity, integrity and privacy queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.stored import fingerprint
from ..session import table
from .registry import query


@query("id_04", "WITH m AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part), x AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM m) SELECT a, b, CASE WHEN nb = 1 THEN '1' ELSE 'n' END || ':' || CASE WHEN na = 1 THEN '1' ELSE 'n' END AS cardinality FROM x")
def id_04(spark, sf_dir):
    """Cardinality of every mapping row; only 1:1 stays exact."""
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct()
    many = lambda c: F.when(F.count("*").over(Window.partitionBy(c)) == 1, "1").otherwise("n")
    return m.select("a", "b", F.concat_ws(":", many("b"), many("a")).alias("cardinality"))


@query("id_09", "WITH m AS (SELECT DISTINCT o_custkey AS alias, o_orderpriority AS canonical FROM orders) SELECT alias, min(canonical) AS canonical FROM m GROUP BY 1 HAVING count(*) = 1")
def id_09(spark, sf_dir):
    """Aliases of one canonical id; those of two are dropped as conflicting."""
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderpriority").alias("canonical"))
    return m.groupBy("alias").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").select("alias", "canonical")


@query("id_02", "WITH m AS (SELECT DISTINCT p_type AS label, p_brand AS target FROM part), u AS (SELECT label, min(target) AS target FROM m GROUP BY 1 HAVING count(*) <= 2) SELECT target, min(label) AS label FROM u GROUP BY 1")
def id_02(spark, sf_dir):
    """Nominations by label: unambiguous labels, one for each target; candidates only."""
    m = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("label")).agg(F.countDistinct("p_brand").alias("n"), F.min("p_brand").alias("target")).where("n <= 2")
    return m.groupBy("target").agg(F.min("label").alias("label"))


@query("id_03", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(lower(text))) AS representative FROM documents")
def id_03(spark, sf_dir):
    """Representative of every document under equality of lower-cased texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("k"))
    hub = rows.groupBy("k").agg(F.min("doc_id").alias("representative"))
    return rows.join(hub, "k").select("doc_id", "representative")


@query("cx_05", "WITH a AS (SELECT DISTINCT lower(p_type) AS alias, p_brand AS node FROM part UNION SELECT DISTINCT lower(p_brand), p_brand FROM part) SELECT alias, count(DISTINCT node) AS nodes, count(DISTINCT node) > 1 AS ambiguous FROM a WHERE alias NOT IN (SELECT lower(p_name) FROM part) GROUP BY 1")
def cx_05(spark, sf_dir):
    """Aliases and whether they are ambiguous; canonical ids are reserved."""
    p = table(spark, sf_dir, "part")
    aliases = p.select(F.lower("p_type").alias("alias"), F.col("p_brand").alias("node")).union(p.select(F.lower("p_brand"), "p_brand")).distinct()
    free = aliases.join(p.select(F.lower("p_name").alias("alias")), "alias", "left_anti")
    return free.groupBy("alias").agg(F.countDistinct("node").alias("nodes")).withColumn("ambiguous", F.col("nodes") > 1)


ROWS = "SELECT sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, epoch(l_shipdate)::BIGINT)) AS h FROM lineitem"
LEVEL = "SELECT left(h, {0}) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM {1} GROUP BY left(h, {0})"


@query("cx_06", f"WITH r AS ({ROWS}), a AS ({LEVEL.format(8, 'r')}), b AS ({LEVEL.format(4, 'a')}) SELECT sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM b")
def cx_06(spark, sf_dir):
    """Fingerprint of a table: digests of whole rows, hashed in groups by their first letters, level by level."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *map(cents, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "l_returnflag", "l_linestatus", F.unix_timestamp("l_shipdate")]
    h = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).cast("binary"), 256)
    return fingerprint(table(spark, sf_dir, "lineitem").select(h.alias("h")))


@query("in_01", """SELECT 'line_has_order' AS contract, count(*) AS checked, count(*) FILTER (o_orderkey IS NULL) AS violations FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'line_is_unique', count(*), sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'quantity_is_positive', count(*), count(*) FILTER (NOT coalesce(l_quantity > 0, false)) FROM lineitem
    UNION ALL SELECT 'order_has_customer', count(*), count(*) FILTER (c_custkey IS NULL) FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def in_01(spark, sf_dir):
    """Integrity contracts: rows checked and violations of each."""
    lines, orders, customers = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))

    def contract(name, rows, bad):
        return rows.agg(F.lit(name).alias("contract"), F.count("*").alias("checked"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("violations"))

    keys = orders.select("o_orderkey")
    return (
        contract("line_has_order", lines.join(keys, lines.l_orderkey == keys.o_orderkey, "left"), F.col("o_orderkey").isNull())
        .unionByName(contract("line_is_unique", lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")), F.col("n") - 1))
        .unionByName(contract("quantity_is_positive", lines, ~F.coalesce(F.col("l_quantity") > 0, F.lit(False))))
        .unionByName(contract("order_has_customer", orders.join(customers, orders.o_custkey == customers.c_custkey, "left"), F.col("c_custkey").isNull()))
    )


@query("pv_02", "WITH held AS (SELECT c_custkey FROM customer WHERE sha256('salt' || chr(31) || 'person:' || c_name) < '2') SELECT (SELECT count(*) FROM held) AS people, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM held)) AS edges, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM held))) AS records")
def pv_02(spark, sf_dir):
    """What a suppression list by salted key withholds; counts only."""
    from ..functions.text import salted_key

    held = table(spark, sf_dir, "customer").where(salted_key("salt", "person", F.col("c_name")) < "2").select("c_custkey")
    edges = table(spark, sf_dir, "orders").join(held, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    records = table(spark, sf_dir, "lineitem").join(edges, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(held, "people").crossJoin(F.broadcast(n(edges, "edges"))).crossJoin(F.broadcast(n(records, "records")))


@query("jn_20", "WITH now AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0), was AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0) SELECT CASE WHEN was.doc_id IS NULL THEN 'new' WHEN now.doc_id IS NULL THEN 'missing' WHEN now.h <> was.h THEN 'changed' ELSE 'complete' END AS state, count(*) AS records FROM now FULL JOIN was ON now.doc_id = was.doc_id GROUP BY 1")
def jn_20(spark, sf_dir):
    """Re-hashed records against those on file."""
    d = table(spark, sf_dir, "documents")
    md5 = lambda c: F.md5(c.cast("binary"))
    now = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("a"), md5(F.col("text")).alias("ha"))
    was = d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("b"), md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hb"))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(F.col("ha") != F.col("hb"), "changed").otherwise("complete")
    return now.join(was, F.col("a") == F.col("b"), "full").groupBy(state.alias("state")).agg(F.count("*").alias("records"))
