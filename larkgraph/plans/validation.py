"""Partitions against held-out labels, and what chance gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import below, draw, draw_sql
from ..operators import partitions as p
from ..session import table
from ..sources.star import SQL, annotations, hierarchy
from .registry import query

# Two labels of every customer: the nation, and the market segment.
MI = """cells AS (SELECT a, b, count(*) AS n FROM t GROUP BY ALL), ra AS (SELECT a, sum(n) AS s FROM cells GROUP BY 1), rb AS (SELECT b, sum(n) AS s FROM cells GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS n FROM cells)"""
EMI = """ps AS (SELECT x.s::BIGINT AS a, y.s::BIGINT AS b, count(*) AS m, any_value(tot.n) AS n FROM ra AS x, rb AS y, tot GROUP BY 1, 2),
    pt AS (SELECT *, unnest(range(greatest(1, a + b - n), least(a, b) + 1)) AS x FROM ps),
    emi AS (SELECT sum(m * x / n::DOUBLE * ln(n * x / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(n + x - a - b + 1))) AS e FROM pt),
    h AS (SELECT (SELECT sum(-s / n::DOUBLE * ln(s / n::DOUBLE)) FROM ra, tot) AS ha, (SELECT sum(-s / n::DOUBLE * ln(s / n::DOUBLE)) FROM rb, tot) AS hb),
    k AS (SELECT (SELECT sum(s * (s - 1) / 2.0) FROM ra)::DOUBLE AS pa, (SELECT sum(s * (s - 1) / 2.0) FROM rb)::DOUBLE AS pb, n * (n - 1) / 2.0::DOUBLE AS pt FROM tot)"""
SCORE = "sum(c.n / tot.n::DOUBLE * ln(tot.n * c.n / (ra.s::DOUBLE * rb.s))) AS mi, sum(c.n * (c.n - 1) / 2.0)::DOUBLE AS cells"
RATES = "(mi - e) / ((ha + hb) / 2 - e) AS ami, (cells - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt) AS ari"
LABELS = "t AS (SELECT c_custkey AS id, c_nationkey % 7 AS a, c_mktsegment AS b FROM customer)"


def labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 7).alias("a"), F.col("c_mktsegment").alias("b"))


@query("an_19", f"WITH t AS (SELECT source AS a, lang AS b FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), {MI}, {EMI}, s AS (SELECT {SCORE} FROM cells AS c JOIN ra USING (a) JOIN rb USING (b), tot) SELECT round(ami, 7) AS ami, round(ari, 7) AS ari FROM (SELECT {RATES} FROM s, emi, h, k)")
def an_19(spark, sf_dir):
    """Adjusted mutual information of sources and languages."""
    return p.adjusted_mutual_information(table(spark, sf_dir, "documents"), "source", "lang").select(F.round("ami", 7).alias("ami"), F.round("ari", 7).alias("ari"))


@query("an_20", f"""WITH {LABELS}, {MI}, {EMI}, s AS (SELECT {SCORE} FROM cells AS c JOIN ra USING (a) JOIN rb USING (b), tot), seen AS (SELECT {RATES} FROM s, emi, h, k),
    own AS (SELECT id, a, b, row_number() OVER (ORDER BY id) AS place FROM t),
    each AS (SELECT i AS shuffle, id, b, row_number() OVER (PARTITION BY i ORDER BY {draw_sql(99, 'i', 'id')}, id) AS place FROM own, range(1, 201) AS r(i)),
    dealt AS (SELECT shuffle, o.a, e.b, count(*) AS n FROM each AS e JOIN own AS o USING (place) GROUP BY ALL),
    z AS (SELECT shuffle, {SCORE} FROM dealt AS c JOIN ra USING (a) JOIN rb USING (b), tot GROUP BY 1), y AS (SELECT {RATES} FROM z, emi, h, k)
    SELECT round(seen.ami, 7) AS ami, round(seen.ari, 7) AS ari, round(avg(y.ami), 7) AS shuffled_ami, round(avg(y.ari), 7) AS shuffled_ari, (1 + count(*) FILTER (y.ami >= seen.ami - 1e-12)) / 201.0::DOUBLE AS p_ami, (1 + count(*) FILTER (y.ari >= seen.ari - 1e-12)) / 201.0::DOUBLE AS p_ari, (SELECT n FROM tot) AS rows FROM y, seen GROUP BY seen.ami, seen.ari""")
def an_20(spark, sf_dir):
    """Agreement of nations with market segments against 200 shuffles."""
    out = p.against_shuffles(labels(spark, sf_dir), "id", "a", "b")
    return out.select(*(F.round(c, 7).alias(c) for c in ("ami", "ari", "shuffled_ami", "shuffled_ari")), "p_ami", "p_ari", "rows")


@query("gr_12", f"SELECT c_custkey, {draw_sql(5, 'c_custkey')} AS draw, {draw_sql(5, 'c_custkey', '1')} % 100 AS below_100, row_number() OVER (ORDER BY {draw_sql(11, 'c_custkey')}, c_custkey)::BIGINT AS place FROM customer")
def gr_12(spark, sf_dir):
    """Seeded draws and a seeded shuffle of all customers."""
    from ..operators.stored import running

    c = table(spark, sf_dir, "customer").select("c_custkey", draw(5, F.col("c_custkey")).alias("draw"), below(100, 5, F.col("c_custkey"), 1).alias("below_100"), draw(11, F.col("c_custkey")).alias("_at"))
    return running(c, F.struct("_at", "c_custkey"), place=F.lit(1)).select("c_custkey", "draw", "below_100", F.col("place").cast("long").alias("place"))


@query("an_13", f"""WITH RECURSIVE {SQL['ann']}, {SQL['isa']}, {SQL['clo']}, {SQL['ic']}, own AS MATERIALIZED (SELECT DISTINCT entity, ancestor AS term FROM ann JOIN clo ON clo.node = ann.term WHERE ann.n > 0 AND ancestor <> 'ROOT'),
    held AS MATERIALIZED (SELECT entity, own.term, ic FROM own JOIN ic ON ic.term = own.term), w AS (SELECT entity, sum(ic) AS w FROM held GROUP BY 1), e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM own)),
    d AS (SELECT i, {draw_sql(7, 'i', '0')} % m.n AS a, {draw_sql(7, 'i', '1')} % m.n AS b FROM range(20000) AS r(i), (SELECT any_value(n) AS n FROM e) AS m), q AS MATERIALIZED (SELECT i, x.entity AS a, y.entity AS b FROM d JOIN e AS x ON x.k = d.a JOIN e AS y ON y.k = d.b WHERE d.a <> d.b),
    s AS (SELECT i, sum(h.ic) AS shared FROM q JOIN held AS h ON h.entity = q.a JOIN held AS g ON g.entity = q.b AND g.term = h.term GROUP BY 1),
    z AS (SELECT coalesce(shared, 0) / (wa.w + wb.w - coalesce(shared, 0)) AS score FROM q LEFT JOIN s USING (i) JOIN w AS wa ON wa.entity = a JOIN w AS wb ON wb.entity = b)
    SELECT count(*) AS pairs, round(quantile_cont(score, 0.95), 7) AS strong, round(quantile_cont(score, 0.5), 7) AS median FROM z""")
def an_13(spark, sf_dir):
    """What similarity two customers have by chance, from 20,000 seeded pairs."""
    from ..operators.ontology import closure, information_content
    from ..operators.stored import side, written

    ann = written(annotations(spark, sf_dir).where("n > 0").select("entity", "term"))
    closed = closure(hierarchy(spark, sf_dir))
    content = information_content(ann, closed)
    # Every node but the root is its own ancestor, so those that hold any know it from their annotations.
    holders = ann.join(side(closed.where("node = ancestor AND node <> 'ROOT'").select(F.col("node").alias("term"))), "term", "left_semi").select("entity").distinct()

    def own(asked):
        up = side(closed.select(F.col("node").alias("term"), "ancestor").where("ancestor <> 'ROOT'"))
        return ann.join(asked, "entity", "left_semi").join(up, "term").select("entity", F.col("ancestor").alias("term")).distinct()

    out = p.background(spark, own, content, entities=holders)
    return out.select("pairs", F.round("strong", 7).alias("strong"), F.round("median", 7).alias("median"))
