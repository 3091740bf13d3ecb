"""Licence-aware release queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.licences import licence_class, licence_class_sql
from ..session import table
from .registry import query

# All lines that name a licence, as one text: the class is that of the licence that restricts most.
LINES = "array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]e')), chr(10))"


def _classed(spark, sf_dir):
    lines = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("(?i)licen[sc]e")), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", licence_class(lines).alias("class"))


@query("ag_15", f"SELECT source, {licence_class_sql('l')} AS class, count(*) AS texts FROM (SELECT source, {LINES} AS l FROM documents) GROUP BY 1, 2")
def ag_15(spark, sf_dir):
    """Licence classes by source."""
    return _classed(spark, sf_dir).groupBy("source", "class").agg(F.count("*").alias("texts"))


@query("rl_02", f"SELECT CASE WHEN class = 'non_commercial' THEN 'licence' WHEN n_chars < 100 THEN 'too_short' WHEN class = 'unknown' THEN 'link_only' ELSE 'copied' END AS reason, count(*) AS texts, sum(CASE WHEN class = 'open' AND n_chars >= 100 THEN n_chars END)::BIGINT AS chars FROM (SELECT n_chars, {licence_class_sql('l')} AS class FROM (SELECT n_chars, {LINES} AS l FROM documents)) GROUP BY 1")
def rl_02(spark, sf_dir):
    """Why each text is kept out, only linked, or copied."""
    reason = F.when(F.col("class") == "non_commercial", "licence").when(F.col("n_chars") < 100, "too_short").when(F.col("class") == "unknown", "link_only").otherwise("copied")
    return _classed(spark, sf_dir).withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("texts"), F.sum(F.when((F.col("class") == "open") & (F.col("n_chars") >= 100), F.col("n_chars"))).alias("chars"))


@query("ag_19", "SELECT CASE WHEN l_returnflag = 'R' THEN 'skipped:returned' WHEN l_linestatus = 'F' THEN 'skipped:closed' ELSE 'kept' END AS counter, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'read', count(*) FROM lineitem")
def ag_19(spark, sf_dir):
    """Counters of one activity: read, kept, and skipped by reason, in one pass."""
    reason = F.when(F.col("l_returnflag") == "R", "skipped:returned").when(F.col("l_linestatus") == "F", "skipped:closed").otherwise("kept")
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("read"), reason)).alias("counter"))
    return rows.groupBy("counter").agg(F.count("*").alias("n"))


@query("snk_03", "SELECT p, count(*) AS triples FROM (SELECT 'a' AS p FROM customer UNION ALL SELECT 'name' FROM customer UNION ALL SELECT 'locatedIn' FROM customer) GROUP BY 1")
def snk_03(spark, sf_dir):
    """Triples of the customers' projection by predicate."""
    c = table(spark, sf_dir, "customer")
    po = F.array(F.struct(F.lit("a").alias("p"), F.lit("Customer").alias("o")), F.struct(F.lit("name").alias("p"), F.col("c_name").alias("o")), F.struct(F.lit("locatedIn").alias("p"), F.concat(F.lit("N:"), "c_nationkey").alias("o")))
    triples = c.select(F.concat(F.lit("C:"), "c_custkey").alias("s"), F.explode(po).alias("x")).select("s", "x.p", "x.o")
    return triples.groupBy("p").agg(F.count("*").alias("triples"))
