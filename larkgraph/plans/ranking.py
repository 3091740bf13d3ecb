"""Phenotype-style ranking: likelihood ratios, Resnik, fusion, ties, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ontology as o
from ..operators import ranking as r
from ..operators.stored import keep, running, written
from ..session import table
from ..sources import star
from .ontology import closed
from .registry import query

#: Fixed query terms: parts and kinds that every scale factor has.
PRESENT, ABSENT = ("P:1", "P:17", "P:42"), ("P:99",)


def _terms(spark, ids):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("query"))


def _setting(spark, sf_dir):
    ann, closure = written(star.annotations(spark, sf_dir)), written(closed(spark, sf_dir))  # both are read several times
    present = ann.where("n > 0").select("entity", "term", r.annotation_frequency(F.col("n"), F.col("m"), F.col("iea")).alias("frequency"))
    excluded = ann.where("n = 0").select("entity", "term")
    content = written(o.information_content(present, closure))
    background = content.select("term", F.exp(-F.col("ic")).alias("share"))
    return closure, present, excluded, content, background


FREQ = "greatest((n + 1) / (m + 2)::DOUBLE * CASE WHEN iea THEN 0.7 ELSE 1.0 END, 0.01)"
HEAD = star.with_views("isa", "clo", "ann", "ic")
VALUES = "q AS (SELECT unnest(['P:1', 'P:17', 'P:42']) AS query), z AS (SELECT 'P:99' AS query)"
LR = f""", {VALUES},
    pres AS (SELECT entity, term, {FREQ} AS f FROM ann WHERE n > 0), excl AS (SELECT entity, term FROM ann WHERE n = 0),
    dir AS (SELECT query, entity, max(f) AS f, max(f) FILTER (term = query) AS own FROM q JOIN clo ON ancestor = query JOIN pres ON term = node GROUP BY ALL),
    dirs AS (SELECT query, entity, ln(f / exp(-ic)) AS lr, CASE WHEN own = f THEN 'exact' ELSE 'descendant' END AS kind, 2 AS w FROM dir JOIN ic ON ic.term = query),
    ups AS (SELECT query, entity, max(ln(f / exp(-ic))) AS lr, 'ancestor' AS kind, 1 AS w FROM q JOIN clo ON node = query AND ancestor <> query JOIN pres ON pres.term = ancestor JOIN ic ON ic.term = ancestor GROUP BY query, entity HAVING lr > ln(0.1)),
    cons AS (SELECT DISTINCT query, entity, -4.0::DOUBLE AS lr, 'conflict' AS kind, 3 AS w FROM q JOIN clo ON node = query JOIN excl ON term = ancestor),
    pe AS (SELECT query, entity, arg_max(lr, w) AS log_lr, arg_max(kind, w) AS kind FROM (SELECT * FROM dirs UNION ALL SELECT * FROM ups UNION ALL SELECT * FROM cons) GROUP BY ALL),
    ex AS (SELECT query, entity, min(ln(greatest(1 - f, 0.05))) AS lr FROM z JOIN clo ON ancestor = query JOIN pres ON term = node GROUP BY ALL),
    ag AS (SELECT DISTINCT query, entity, ln(2.0) AS lr FROM z JOIN clo ON node = query JOIN excl ON term = ancestor),
    ab AS (SELECT coalesce(ex.query, ag.query) AS query, coalesce(ex.entity, ag.entity) AS entity, coalesce(ex.lr, ag.lr) AS log_lr FROM ex FULL JOIN ag ON ex.query = ag.query AND ex.entity = ag.entity),
    cand AS (SELECT DISTINCT entity FROM pres),
    sc AS (SELECT cand.entity, 3 * ln(0.1) + coalesce((SELECT sum(log_lr - ln(0.1)) FROM pe WHERE pe.entity = cand.entity), 0) + coalesce((SELECT sum(log_lr) FROM ab WHERE ab.entity = cand.entity), 0) AS score FROM cand),
    rs AS (SELECT cand.entity, coalesce((SELECT sum(b) FROM (SELECT query, max(ic.ic) AS b FROM pres p JOIN clo c ON c.node = p.term JOIN clo d ON d.ancestor = c.ancestor JOIN q ON d.node = q.query JOIN ic ON ic.term = c.ancestor WHERE p.entity = cand.entity GROUP BY query)), 0) / (SELECT sum(ic) FROM q JOIN ic ON term = query) AS score FROM cand)"""


@query("an_01", f"{star.with_views('ann')} SELECT entity, term, round({FREQ}, 6) AS frequency FROM ann WHERE n > 0")
def an_01(spark, sf_dir):
    """Frequency of every annotation."""
    ann = star.annotations(spark, sf_dir).where("n > 0")
    return ann.select("entity", "term", F.round(r.annotation_frequency(F.col("n"), F.col("m"), F.col("iea")), 6).alias("frequency"))


@query("an_02", f"{HEAD}{LR} SELECT query, entity, round(log_lr, 6) AS log_lr, kind FROM pe")
def an_02(spark, sf_dir):
    """What each entity says about each present term."""
    closure, present, excluded, _, background = _setting(spark, sf_dir)
    found = r.present_evidence(_terms(spark, PRESENT), closure, present, excluded, background)
    return found.select("query", "entity", F.round("log_lr", 6).alias("log_lr"), "kind")


@query("an_03", f"{HEAD}{LR} SELECT query, entity, round(log_lr, 6) AS log_lr FROM ab")
def an_03(spark, sf_dir):
    """What each entity says about each absent term."""
    closure, present, excluded, *_ = _setting(spark, sf_dir)
    return r.absent_evidence(_terms(spark, ABSENT), closure, present, excluded).withColumn("log_lr", F.round("log_lr", 6))


def _scores(spark, sf_dir):
    closure, present, excluded, content, background = _setting(spark, sf_dir)
    pe = r.present_evidence(_terms(spark, PRESENT), closure, present, excluded, background)
    ab = r.absent_evidence(_terms(spark, ABSENT), closure, present, excluded)
    candidates = present.select("entity").distinct()
    lr = r.scores(candidates, len(PRESENT), pe, ab)
    rs = candidates.join(r.resnik(_terms(spark, PRESENT), closure, present, content), "entity", "left").select("entity", F.coalesce("score", F.lit(0.0)).alias("score"))
    return lr, rs


@query("an_04", f"{HEAD}{LR} SELECT entity, round(score, 6) AS score, round(exp(score - max(score) OVER ()) / sum(exp(score)) OVER () * exp(max(score) OVER ()), 6) AS probability FROM sc")
def an_04(spark, sf_dir):
    """Likelihood-ratio score and probability of every candidate."""
    lr, _ = _scores(spark, sf_dir)
    return lr.select("entity", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query("an_06", f"{HEAD}{LR} SELECT entity, round(score, 6) AS score FROM rs")
def an_06(spark, sf_dir):
    """Resnik score of every candidate."""
    return _scores(spark, sf_dir)[1].select("entity", F.round("score", 6).alias("score"))


def _ranks(table_name: str, digits: int = 9) -> str:
    return f"(SELECT entity, (min(place) OVER (PARTITION BY tie) + max(place) OVER (PARTITION BY tie)) / 2.0 AS mid FROM (SELECT *, sum(step) OVER (ORDER BY place) AS tie FROM (SELECT entity, row_number() OVER o AS place, CASE WHEN lag(score) OVER o - score > 1e-9 THEN 1 ELSE 0 END AS step FROM (SELECT entity, round(score, {digits}) AS score FROM {table_name}) WINDOW o AS (ORDER BY score DESC, entity))))"


@query("an_07", f"{HEAD}{LR} SELECT a.entity, a.mid AS rank_lr, b.mid AS rank_resnik, round(0.25 / (1 + a.mid) + 0.75 / (1 + b.mid), 9) AS fused FROM {_ranks('sc')} a JOIN {_ranks('rs')} b USING (entity) ORDER BY fused DESC, entity LIMIT 20")
def an_07(spark, sf_dir):
    """Flagship: the first 20 candidates by two scorers and their rank fusion."""
    lr, rs = (keep(x.select("entity", F.round("score", 9).alias("score"))) for x in _scores(spark, sf_dir))
    a, b = (r.midranks(x.select("entity", "score"), "score", "entity") for x in (lr, rs))
    fused = r.fuse(a, b)
    out = fused.join(a.select("entity", F.col("rank_mid").alias("rank_lr")), "entity").join(b.select("entity", F.col("rank_mid").alias("rank_resnik")), "entity")
    out = out.withColumn("fused", F.round("fused", 9))
    return out.orderBy(F.desc("fused"), "entity").limit(20).select("entity", "rank_lr", "rank_resnik", "fused")


SPEND = "spend AS (SELECT c_custkey AS entity, c_nationkey AS nation, floor(c_acctbal / 50) AS score FROM customer)"


def _spend(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 50).cast("double").alias("score"))


@query("rk_01", f"WITH {SPEND} SELECT entity, (min(place) OVER t + max(place) OVER t) / 2.0 AS rank_mid FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, entity) AS place FROM spend) WINDOW t AS (PARTITION BY nation, score)")
def rk_01(spark, sf_dir):
    """Mid-ranks of scores within each nation."""
    return r.midranks(_spend(spark, sf_dir), "score", "entity", partition=("nation",)).select("entity", "rank_mid")


@query("rk_02", f"WITH {SPEND} SELECT entity, min(place) OVER t AS rank_best, max(place) OVER t AS rank_worst, count(*) OVER t AS tied FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, entity) AS place FROM spend) WINDOW t AS (PARTITION BY nation, score)")
def rk_02(spark, sf_dir):
    """Best and worst rank and size of each tie."""
    return r.midranks(_spend(spark, sf_dir), "score", "entity", partition=("nation",)).select("entity", "rank_best", "rank_worst", "tied")


@query("rk_03", "WITH a AS (SELECT c_custkey AS entity, rank() OVER (ORDER BY c_acctbal DESC, c_custkey)::DOUBLE AS ra, rank() OVER (ORDER BY c_name, c_custkey)::DOUBLE AS rb FROM customer) SELECT entity, round(0.25 / (1 + ra) + 0.75 / (1 + rb), 9) AS fused FROM a")
def rk_03(spark, sf_dir):
    """Weighted reciprocal-rank fusion of two orders."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal", "c_name")
    balance = running(c.select("c_acctbal", "entity"), F.struct((-F.col("c_acctbal")).alias("b"), "entity"), rank_mid=F.lit(1))
    a = balance.select("entity", "rank_mid")
    names = running(c.select("c_name", "entity"), F.struct("c_name", "entity"), rank_mid=F.lit(1))
    return r.fuse(a, names.select("entity", "rank_mid")).withColumn("fused", F.round("fused", 9))


@query("rk_04", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rk_04(spark, sf_dir):
    """Top-k by a full comparator."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("rk_05", "SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def rk_05(spark, sf_dir):
    """Top-k per kind."""
    return r.top_in_group(table(spark, sf_dir, "orders"), 5, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderpriority", "o_orderkey", "place")


@query("rk_06", "SELECT l_orderkey, max(l_extendedprice) AS score, arg_min(l_partkey, (-l_extendedprice, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def rk_06(spark, sf_dir):
    """Best hit of each node, ties by the smaller key."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("score"), F.min_by("l_partkey", F.struct(-F.col("l_extendedprice"), "l_partkey")).alias("l_partkey"))


@query("rk_07", "SELECT o_orderkey, 1000 * (o_orderpriority LIKE '1%')::INT + 10 * (40 - 5 * CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) + (year(o_orderdate) - 1990) AS score FROM orders")
def rk_07(spark, sf_dir):
    """Study score: exactness, then status, then year."""
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    exact = F.col("o_orderpriority").startswith("1").cast("int")
    score = 1000 * exact + 10 * (40 - 5 * status) + (F.year("o_orderdate") - 1990)
    return table(spark, sf_dir, "orders").select("o_orderkey", score.cast("long").alias("score"))


@query("rk_11", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200")
def rk_11(spark, sf_dir):
    """A page of results, with the total."""
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    page = found.orderBy("o_orderdate", "o_orderkey").offset(200).limit(100).select("o_orderkey")
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))
