"""Identity links between terminologies: consistency to a fixpoint, published links, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import ledger
from ..session import table
from .registry import query

# Customers and their first urgent order; orders and the part of their first line; parts and the least supplier of their lines.
URGENT = "urgent AS (SELECT 'C:' || o_custkey AS a, 'O:' || min(o_orderkey) AS b FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)"
FIRST = "line1 AS (SELECT 'O:' || l_orderkey AS a, 'P:' || min(l_partkey) AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey)"
MADE = "made AS (SELECT 'P:' || l_partkey AS a, 'S:' || min(l_suppkey) AS b FROM lineitem GROUP BY l_partkey)"


def _pid(prefix, column):
    return F.concat(F.lit(prefix), column)


def urgent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).select(_pid("C:", "o_custkey").alias("a"), _pid("O:", "o").alias("b"))


def first_part(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p")).select(_pid("O:", "l_orderkey").alias("a"), _pid("P:", "p").alias("b"))


def made(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).select(_pid("P:", "l_partkey").alias("a"), _pid("S:", "s").alias("b"))


def _exact(links):
    return links.withColumns({"exact": F.lit(True), "conflict": F.lit(None).cast("string")})


def _components(k: int, links: str) -> str:
    """CTEs c{k} (id, comp): the least id that each can reach over the exact rows of ``links``."""
    return f"""e{k} AS MATERIALIZED (SELECT a, b FROM {links} WHERE exact UNION SELECT b, a FROM {links} WHERE exact),
    c{k}(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM e{k} UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.c{k} AS u JOIN e{k} AS e ON e.a = u.id JOIN recurring.c{k} AS v ON v.id = e.b WHERE v.comp < u.comp ORDER BY u.id, v.comp))"""


def _round(k: int, place: str) -> str:
    """CTE x{k + 1}: the links x{k} after one round in which the weakest prefix of a bad cluster is cut."""
    return f"""{_components(k, f'x{k}')},
    m{k} AS (SELECT comp, split_part(id, ':', 1) AS p, count(*) AS n FROM c{k} GROUP BY 1, 2),
    w{k} AS (SELECT comp, arg_min(p, {{'o': {place}, 'p': p}}) AS cut FROM m{k} WHERE comp IN (SELECT comp FROM m{k} WHERE n > 1) GROUP BY 1),
    x{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (exact AND NOT coalesce(cut IN (split_part(a, ':', 1), split_part(b, ':', 1)), false) AS exact, CASE WHEN exact AND cut IN (split_part(a, ':', 1), split_part(b, ':', 1)) THEN 'cluster_conflict' ELSE conflict END AS conflict) FROM x{k} AS x LEFT JOIN c{k} ON id = a LEFT JOIN w{k} USING (comp))"""


def _fixpoint(rounds: int, place: str) -> str:
    return ", ".join(_round(k, place) for k in range(rounds))


def _order(*weakest: str) -> str:
    return "CASE p " + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(weakest)) + " ELSE 0 END"


@query("id_06", f"WITH RECURSIVE {URGENT}, {FIRST}, {MADE}, x0 AS MATERIALIZED (SELECT a, b, true AS exact, NULL::VARCHAR AS conflict FROM (SELECT * FROM urgent UNION ALL SELECT * FROM line1 UNION ALL SELECT * FROM made)), {_fixpoint(4, _order('S', 'P', 'O', 'C'))} SELECT a, b, exact, conflict FROM x4")
def id_06(spark, sf_dir):
    """Links of customers, orders, parts and suppliers, demoted round by round until no cluster holds two of a kind; suppliers give way first."""
    links = urgent(spark, sf_dir).unionByName(first_part(spark, sf_dir)).unionByName(made(spark, sf_dir))
    return al.consistent(_exact(links), weakest=("S", "P", "O", "C"))


APART = "apart AS (SELECT DISTINCT u.a AS a, 'P:' || l_partkey AS b FROM urgent u JOIN lineitem ON 'O:' || l_orderkey = u.b WHERE l_returnflag = 'R')"


def _cross(k: int) -> str:
    return f"""{_components(k, f'x{k}')}, bad{k} AS (SELECT DISTINCT i.comp FROM apart JOIN c{k} AS i ON i.id = apart.a JOIN c{k} AS j ON j.id = apart.b WHERE i.comp = j.comp),
    x{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (exact AND NOT (fresh AND coalesce(comp IN (SELECT comp FROM bad{k}), false)) AS exact, CASE WHEN exact AND fresh AND comp IN (SELECT comp FROM bad{k}) THEN 'cross_source' ELSE conflict END AS conflict) FROM x{k} AS x LEFT JOIN c{k} ON id = a)"""


@query("id_07", f"WITH RECURSIVE {URGENT}, {FIRST}, {APART}, x0 AS MATERIALIZED (SELECT a, b, true AS exact, NULL::VARCHAR AS conflict, true AS fresh FROM line1 UNION ALL SELECT a, b, true, NULL, false FROM urgent), {_fixpoint(3, _order('P', 'C', 'O'))}, {_cross(3)}, {_cross(4)} SELECT a, b, exact, conflict FROM x5 WHERE fresh")
def id_07(spark, sf_dir):
    """New links of orders to parts against published ones of customers to orders, and pairs of customer and part that others tell apart."""
    from ..operators.stored import keep

    published = keep(urgent(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(_pid("O:", "l_orderkey").alias("b"), _pid("P:", "l_partkey").alias("p"))
    apart = published.join(lines, "b").select("a", F.col("p").alias("b"))
    return al.against_background(_exact(first_part(spark, sf_dir)), published, apart, "P").select("a", "b", "exact", "conflict")


@query("cx_21", f"WITH RECURSIVE {URGENT}, {FIRST}, {APART}, x0 AS MATERIALIZED (SELECT a, b, true AS exact FROM line1 UNION ALL SELECT a, b, true FROM urgent), {_components(0, 'x0')} SELECT apart.a, apart.b, i.comp AS component FROM apart JOIN c0 AS i ON i.id = a JOIN c0 AS j ON j.id = b WHERE i.comp = j.comp")
def cx_21(spark, sf_dir):
    """Pairs told apart by one source that the exact links of all make one."""
    published = urgent(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(_pid("O:", "l_orderkey").alias("b"), _pid("P:", "l_partkey").alias("p"))
    apart = published.join(lines, "b").select("a", F.col("p").alias("b"))
    return al.contradictions(_exact(published.unionByName(first_part(spark, sf_dir))), apart)


CARD = "m AS (SELECT DISTINCT 'O:' || l_orderkey AS a, 'P:' || l_partkey AS b FROM lineitem WHERE l_linenumber <= 2), k AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS f, count(*) OVER (PARTITION BY b) AS g FROM m), n AS (SELECT a, b, CASE WHEN g > 1 THEN 'n' ELSE '1' END || ':' || CASE WHEN f > 1 THEN 'n' ELSE '1' END AS cardinality FROM k)"


@query("id_05", f"WITH {CARD} SELECT a, b, cardinality, cardinality IN ('1:1', '1:n') AS exact, CASE cardinality WHEN 'n:1' THEN 'many_to_one' WHEN 'n:n' THEN 'many_to_many' END AS conflict FROM n")
def id_05(spark, sf_dir):
    """Cardinality of links of orders to parts, where several parts of one order are declared aliases."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(_pid("O:", "l_orderkey").alias("a"), _pid("P:", "l_partkey").alias("b")).distinct()
    return al.accept(al.cardinality(_exact(lines)), "O", "one_to_many").select("a", "b", "cardinality", "exact", "conflict")


# Every line is an assertion: of a disease to another terminology by its part and supplier, with what the other columns say.
ROW = """r AS (SELECT 'lines' AS file, l_orderkey * 8 + l_linenumber AS line, 'MONDO:' || l_orderkey AS subject, CASE WHEN l_linenumber = 1 THEN 'skos:exactMatch' WHEN l_linenumber = 2 THEN 'owl:equivalentClass' ELSE 'skos:relatedMatch' END AS predicate,
    CASE WHEN l_suppkey % 9 = 0 THEN 'HGNC:' || l_partkey WHEN l_suppkey % 9 = 1 THEN 'XX:' || l_partkey WHEN l_suppkey % 9 = 2 THEN 'OMIM:x' || l_partkey ELSE CASE WHEN l_linenumber % 2 = 1 THEN 'ORPHA:' ELSE 'OMIM:' END || (l_partkey * 1000 + l_suppkey) END AS object,
    CASE WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN 'semapv:LexicalMatching' WHEN l_discount > 0.08 THEN 'guess' ELSE 'semapv:ManualMappingCuration' END AS justification, CASE WHEN l_tax > 0.07 THEN 'old' ELSE '' END AS conflict,
    'R-DIS-0' || (l_linenumber % 3) AS rule, '1' AS rule_version, CASE WHEN l_quantity > 45 THEN '' ELSE 'https://example.org' END AS evidence_url, l_partkey || '/' || l_quantity::INT AS evidence_locator, sha256(l_orderkey::VARCHAR) AS evidence_sha256, l_quantity = 7 AS revoked FROM lineitem)"""


def assertions(spark, sf_dir):
    """Rows of an identity table, every one a line of an order; and whether a review revokes it."""
    c, s = F.col, lambda x: F.col(x).cast("string")
    number = c("l_linenumber")
    kind = c("l_suppkey") % 9
    other = F.concat(F.when(number % 2 == 1, "ORPHA:").otherwise("OMIM:"), (c("l_partkey") * 1000 + c("l_suppkey")).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("lines").alias("file"),
        (c("l_orderkey") * 8 + number).alias("line"),
        _pid("MONDO:", "l_orderkey").alias("subject"),
        F.when(number == 1, "skos:exactMatch").when(number == 2, "owl:equivalentClass").otherwise("skos:relatedMatch").alias("predicate"),
        F.when(kind == 0, _pid("HGNC:", "l_partkey")).when(kind == 1, _pid("XX:", "l_partkey")).when(kind == 2, _pid("OMIM:x", "l_partkey")).otherwise(other).alias("object"),
        F.when((c("l_returnflag") == "A") & (c("l_discount") > 0.05), "semapv:LexicalMatching").when(c("l_discount") > 0.08, "guess").otherwise("semapv:ManualMappingCuration").alias("justification"),
        F.when(c("l_tax") > 0.07, "old").otherwise("").alias("conflict"),
        F.concat(F.lit("R-DIS-0"), (number % 3).cast("string")).alias("rule"),
        F.lit("1").alias("rule_version"),
        F.when(c("l_quantity") > 45, "").otherwise("https://example.org").alias("evidence_url"),
        F.concat_ws("/", s("l_partkey"), c("l_quantity").cast("int").cast("string")).alias("evidence_locator"),
        F.sha2(s("l_orderkey").cast("binary"), 256).alias("evidence_sha256"),
        (c("l_quantity") == 7).alias("revoked"),
    )
    return rows


POLICY = ledger.Policy((("R-DIS-01", "1", "skos:exactMatch"), ("R-DIS-02", "1", "owl:equivalentClass")))


@query("id_10", f"""WITH RECURSIVE {ROW}, t AS MATERIALIZED (SELECT *, predicate IN ('skos:exactMatch', 'owl:equivalentClass') AS states FROM r),
    q AS MATERIALIZED (SELECT *, CASE WHEN NOT states THEN NULL WHEN revoked THEN 'review_revoked' WHEN conflict <> '' THEN 'source_conflict' WHEN justification = 'guess' THEN 'unknown_justification' WHEN object LIKE 'OMIM:x%' THEN 'invalid_identifier' WHEN object LIKE 'XX:%' THEN 'unknown_entity_regime' WHEN object LIKE 'HGNC:%' THEN 'incompatible_entity_regime'
        WHEN justification = 'semapv:LexicalMatching' THEN 'candidate_method' WHEN evidence_url = '' THEN 'missing_evidence_receipt' END AS why FROM t),
    x0 AS MATERIALIZED (SELECT subject AS a, object AS b, true AS exact FROM q WHERE states AND why IS NULL), {_components(0, 'x0')},
    hit AS (SELECT comp, min(p) AS p FROM (SELECT comp, split_part(id, ':', 1) AS p, count(*) AS n FROM c0 GROUP BY 1, 2) WHERE n > 1 GROUP BY 1),
    names AS (SELECT comp, 'component_prefix_collision:' || string_agg(p, ',' ORDER BY p) AS name FROM (SELECT comp, split_part(id, ':', 1) AS p, count(*) AS n FROM c0 GROUP BY 1, 2) WHERE n > 1 GROUP BY 1),
    joins AS (SELECT DISTINCT i.comp FROM t JOIN c0 AS i ON i.id = subject JOIN c0 AS j ON j.id = object WHERE NOT states AND i.comp = j.comp),
    d AS (SELECT q.*, CASE WHEN states AND why IS NULL THEN CASE WHEN c.comp IN (SELECT comp FROM joins) THEN 'component_collapses_typed_relation' ELSE name END ELSE why END AS reason FROM q LEFT JOIN c0 AS c ON c.id = subject LEFT JOIN names ON names.comp = c.comp)
    SELECT line, CASE WHEN NOT states THEN 'typed_or_candidate' WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM d""")
def id_10(spark, sf_dir):
    """Decisions on all assertions after one review; each keeps its first reason."""
    import tempfile

    rows = ledger.identified(assertions(spark, sf_dir))  # made again from the lines by each reader: a written copy has ten times their size
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="larkgraph-")
    digest = ledger.input_digest(rows)
    reviews = ledger.Reviews(spark, f"{root.rstrip('/')}/reviews-{spark.sparkContext.applicationId}-{digest[:12]}")
    named = ledger.identified(assertions(spark, sf_dir).where("revoked")).distinct().select(F.lit(digest).alias("input_digest"), F.lit("curator").alias("actor"), F.lit("2024-01-01").alias("reviewed_at"), F.lit("seven").alias("reason"), "assertion", F.lit(True).alias("revoked"))
    reviews.append(named)
    return ledger.decide(rows, POLICY, reviews.read(), digest).select("line", "status", "reason")
