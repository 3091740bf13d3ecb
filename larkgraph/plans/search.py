"""Search queries: name tiers, index, relevance, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as s
from ..session import table
from .registry import query

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
INDEX = f"i AS (SELECT doc_id AS id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents)"


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return s.postings(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))), docs.agg(F.count("*").alias("n"))


@query("se_01", "SELECT name, count(*) AS nodes FROM (SELECT p_partkey AS node, lower(p_type) AS name FROM part UNION SELECT p_partkey, lower(p_brand) FROM part UNION SELECT p_partkey, lower(p_name) FROM part) GROUP BY 1")
def se_01(spark, sf_dir):
    """Name index: every name and how many nodes bear it."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("node"), F.explode(F.array_distinct(F.array(F.lower("p_type"), F.lower("p_brand"), F.lower("p_name")))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("nodes"))


@query("se_02", "WITH n AS (SELECT p_partkey AS node, lower(p_type) AS name FROM part UNION SELECT p_partkey, lower(p_name) FROM part), t AS (SELECT *, CASE WHEN name = 'large' THEN 0 WHEN starts_with(name, 'large') THEN 1 WHEN len(list_filter(string_split(name, ' '), lambda x: starts_with(x, 'large'))) > 0 THEN 2 END AS tier FROM n) SELECT node, min(tier)::INT AS tier FROM t WHERE tier IS NOT NULL GROUP BY 1")
def se_02(spark, sf_dir):
    """Exact, prefix and word-prefix hits."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("node"), F.explode(F.array_distinct(F.array(F.lower("p_type"), F.lower("p_name")))).alias("name"))
    return s.tiers(names, "large").select("node", "tier")


@query("se_03", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON replace(lower(c_name), 'customer', '') = replace(lower(s_name), 'supplier', '')")
def se_03(spark, sf_dir):
    """Exact linking of two name lists."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(F.lower("c_name"), "customer", "").alias("k"))
    return c.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(F.lower("s_name"), "supplier", "").alias("k")), "k").select("c_custkey", "s_suppkey")


@query("ag_09", f"WITH {INDEX} SELECT word, count(*) AS df, round(ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)), 6)::DOUBLE AS idf FROM i, n GROUP BY 1")
def ag_09(spark, sf_dir):
    """Document frequency and rarity of every word."""
    index, n = _index(spark, sf_dir)
    return s.inverse_frequency(index, n).withColumn("idf", F.round("idf", 6))


@query("se_12", f"WITH {INDEX}, l AS (SELECT id, sum(tf) AS len FROM i GROUP BY 1), a AS (SELECT avg(len) AS a FROM l), q AS (SELECT * FROM (VALUES ('license', 1.0), ('released', 0.9), ('under', 1.0), ('idiot', 0.78)) AS v(word, weight)), d AS (SELECT word, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM i, n WHERE word IN (SELECT word FROM q) GROUP BY 1) SELECT id, round(sum(weight * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / greatest(a, 1)))), 6)::DOUBLE AS score, count(*) AS matched FROM i JOIN q USING (word) JOIN d USING (word) JOIN l USING (id), a GROUP BY 1 HAVING count(*) >= 2")
def se_12(spark, sf_dir):
    """Relevance of texts for four weighted terms."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    return s.relevance(texts, {"license": 1.0, "released": 0.9, "under": 1.0, "idiot": 0.78}).withColumn("score", F.round("score", 6))


@query("se_04", f"""WITH v AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents), b AS (SELECT DISTINCT unnest({WORDS}) AS w FROM benchmark), a AS (SELECT DISTINCT CASE WHEN length(w) < 8 THEN w || 'x' ELSE 'q' || w || 'x' END AS asked FROM b),
    u AS (SELECT asked FROM a WHERE asked NOT IN (SELECT word FROM v) AND length(asked) >= 4), p AS (SELECT asked, word, damerau_levenshtein(asked, word) AS edits FROM u JOIN v ON abs(length(asked) - length(word)) <= CASE WHEN length(asked) >= 8 THEN 2 ELSE 1 END)
    SELECT asked, word, edits::INT AS edits FROM p WHERE edits <= CASE WHEN length(asked) >= 8 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY asked ORDER BY edits, abs(length(asked) - length(word)), word) = 1""")
def se_04(spark, sf_dir):
    """Spelling corrections of misspelt benchmark words: one edit in short words, two in long ones."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    w = F.col("w")
    wrong = F.when(F.length(w) < 8, F.concat(w, F.lit("x"))).otherwise(F.concat(F.lit("q"), w, F.lit("x")))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("w")).select(wrong.alias("asked")).distinct()
    vocabulary = table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).distinct()
    return s.corrections(asked, vocabulary)
