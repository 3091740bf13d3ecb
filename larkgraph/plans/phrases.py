"""Phrases in running text: mentions, linking, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mentions as m
from ..session import table
from .registry import query

# The dictionary: words of seven letters or more, and runs of two and three words, of the benchmark's items.
SQL = """b AS (SELECT item_id AS node, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
    names AS MATERIALIZED (SELECT DISTINCT node, array_to_string(w[i : i + n - 1], ' ') AS phrase, n FROM (SELECT node, w, unnest(range(1, len(w) + 1)) AS i FROM b), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w) AND (n > 1 OR length(w[i]) >= 7)),
    t AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
    found AS MATERIALIZED (SELECT id, i - 1 AS start, n, array_to_string(w[i : i + n - 1], ' ') AS phrase, w[greatest(i - 3, 1) : i - 1] AS context
        FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM t), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w) AND n < len(w) AND array_to_string(w[i : i + n - 1], ' ') IN (SELECT phrase FROM names))"""


def _words(c):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def names(spark, sf_dir):
    """(phrase, node) of the dictionary."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node"), _words("text").alias("w"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    one = F.filter("w", lambda x: F.length(x) >= 7)
    runs = [F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in (2, 3)]
    return b.select("node", F.explode(F.concat(one, *runs)).alias("phrase")).distinct()


def found(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _words("text").alias("words"))
    return m.mentions(texts, names(spark, sf_dir).select("phrase"))


@query("se_15", f"WITH {SQL}, s AS (SELECT id, start, n, phrase FROM found) SELECT id, start::INT AS start, n::INT AS n, phrase FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.id = s.id AND o.start <= s.start AND o.start + o.n >= s.start + s.n AND o.n > s.n)")
def se_15(spark, sf_dir):
    """Names linked in every document, without those that stand inside a longer one."""
    return m.longest(found(spark, sf_dir)).select("id", "start", "n", "phrase")


@query("se_07", f"""WITH RECURSIVE {SQL}, target AS (SELECT DISTINCT phrase, node FROM names WHERE node % 3 <> 0), single AS (SELECT phrase, count(*) AS targets FROM target GROUP BY 1),
    e AS (SELECT DISTINCT id, phrase, list_reduce([0] || list_transform(context, lambda x: CASE WHEN x IN ('and', 'but', 'with', 'und', 'aber', 'mit') THEN -1 WHEN x IN ('no', 'not', 'without', 'kein', 'keine', 'keinen', 'ohne', 'sans') THEN 1 ELSE 0 END), lambda s, x: CASE WHEN x = -1 THEN 0 WHEN x = 1 THEN 1 ELSE s END) = 1 AS no FROM found),
    s AS MATERIALIZED (SELECT id, node, bool_or(no) AS excluded, bool_or(NOT no AND targets = 1) AS present FROM e JOIN target USING (phrase) JOIN single USING (phrase) GROUP BY 1, 2),
    up AS (SELECT item_id AS node, item_id // 2 AS ancestor FROM benchmark WHERE item_id > 0 UNION SELECT node, ancestor // 2 FROM up WHERE ancestor > 0),
    p AS MATERIALIZED (SELECT id, node FROM s WHERE present AND NOT excluded)
    SELECT id, node, 'present' AS state FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS o JOIN up ON up.node = o.node WHERE o.id = p.id AND up.ancestor = p.node)
    UNION ALL SELECT id, node, 'excluded' FROM s WHERE excluded""")
def se_07(spark, sf_dir):
    """What every document mentions and what it denies, the most specific only; items stand in a binary hierarchy by id."""
    from ..operators.ontology import closure

    ids = table(spark, sf_dir, "benchmark").select("item_id").where("item_id > 0")
    above = closure(ids.select(F.col("item_id").alias("child"), F.floor(F.col("item_id") / 2).alias("parent")))
    above = above.where("node <> ancestor").select("node", "ancestor")
    return m.profile(found(spark, sf_dir), names(spark, sf_dir).where("node % 3 <> 0"), above)
