"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target divided by its words gives the expected copies of each of its documents. The whole part
is certain: so many copies of every document. For the rest, an inclusion probability p, documents are
ranked by random odds over inclusion odds, ``(u/(1-u)) / (p/(1-p))``, and taken in that order as long as
their words fit what the target still lacks; a few further rounds over the documents small enough for the
remaining gap close it. ``u`` comes from a digest of the document's id, so reruns agree.

The cut in the ranking is found without sorting a source in one task. Within a source all inclusion odds are
equal, so ranks ascend with ``u``, whose bins are even: words are summed per source and bin, which finds the bin
of the cut, then again in bins of that bin, and so on, until only a few rows are ordered. A source whose target
is a whole multiple of its words has no gap and no cut. What is kept per source is one row of cuts, so any later
pass decides a document's copies from its own row and that one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents, n_words

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document's words are taken this many times at most.
MOST = 3
#: Bins of a source at each level, and levels: the rows ordered together are a source's rows over ``BINS ** LEVELS``.
BINS, LEVELS = 256, 3
#: Rounds that fill the gap after the first cut.
FILLS = 2
SEED = "mix"


@dataclass(frozen=True)
class Mix:
    """How to mix: weights in source order, most copies, and the digest's seed."""

    weights: tuple[int, ...] = WEIGHTS
    most: int = MOST
    seed: str = SEED


def source_key(source: Column) -> Column:
    """A source's name as a key that is never null; a missing source is one of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def random_unit(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a digest of the id; a null id counts as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def slim(docs: DataFrame, mix: Mix) -> DataFrame:
    """Id, source key, words and random number of every row; the texts stay behind."""
    return docs.select("doc_id", F.col("source"), source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), random_unit(F.col("doc_id"), mix.seed).alias("u"))


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """skey, source_size, target: shares by weight, none above ``most`` times its source, the excess shared again.

    Sharing again and again ends where every source has the lesser of its limit and weight times one common
    level. In ascending order of limit over weight, that level is what is left over the weights that are left
    at the first source that it doesn't fill.
    """
    by_source = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, mix.weights)), (place % len(mix.weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * mix.most)
    order = Window.orderBy((F.col("most").cast("double") / F.col("weight")), "skey")
    filled = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lasting = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("place", F.row_number().over(order)).withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - filled).cast("double") / lasting.cast("double"))
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))).over(Window.partitionBy())
    shared = F.least(F.col("most").cast("double"), level * F.col("weight"))
    return levels.select("skey", "source_size", F.coalesce(shared, F.lit(0.0)).alias("target"))


def _expected(mix: Mix) -> Column:
    ratio = F.col("target") / F.col("source_size").cast("double")
    return F.when(F.col("source_size") > 0, ratio).otherwise(0.0)


def _certain(mix: Mix) -> Column:
    return F.least(F.floor(_expected(mix)), F.lit(mix.most)).cast("long")


def _rank(mix: Mix) -> Column:
    p = F.greatest(_expected(mix) - F.floor(_expected(mix)), F.lit(1e-12))
    return (F.col("u") / (1.0 - F.col("u"))) / (p / (1.0 - p))


def _bin(level: int = LEVELS) -> Column:
    """The bin of a row's place in its source at a level; those of the next level lie inside it."""
    return F.floor(F.col("u") * float(BINS**level)).cast("long")


def _within(k: int) -> Column:
    """Whether a candidate of round ``k`` ranks before that round's cut."""
    b, q, i = F.col(f"bin{k}"), F.col(f"rank{k}"), F.col(f"id{k}")
    mine, rank, oid = F.col("bin"), F.col("rank"), F.col("oid")
    return b.isNull() | (mine < b) | ((mine == b) & F.coalesce((rank < q) | ((rank == q) & (oid <= i)), F.lit(False)))


def _taken(rounds: int) -> Column:
    """Whether one of the rounds so far takes an extra copy of the row."""
    out = F.lit(False)
    for k in range(rounds):
        out = out | (_candidate(k) & _within(k))
    return out


def _candidate(k: int) -> Column:
    left = F.col(f"left{k}")
    return (F.col("certain") < F.col("most")) & (F.col("size") > 0) & (left >= 1) & (F.col("size") <= left if k else F.lit(True))


def _ranked(rows: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    lowest = F.lit(-(1 << 63)).cast("long")
    joined = rows.join(cuts, "skey").withColumn("rank", _rank(mix))
    return joined.withColumns({"bin": _bin(), "oid": F.coalesce(F.col("doc_id"), lowest)})


def cut(rows: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """One row per source: target, certain copies, and for each round the gap it began with and its cut."""
    cuts = targets(rows, mix).withColumns({"certain": _certain(mix), "most": F.lit(mix.most)})
    cuts = scratch.write(cuts.withColumn("left0", F.col("target") - (F.col("certain") * F.col("source_size")).cast("double")), "cuts")
    for k in range(1 + FILLS):
        open_rows = _ranked(rows, cuts, mix).where(_candidate(k) & ~_taken(k))
        edge, every = None, None
        for level in range(1, LEVELS + 1):
            part = open_rows.withColumn("part", _bin(level))
            if edge is not None:
                part = part.join(edge.select("skey", F.col("part").alias("outer"), "before"), "skey").where(_bin(level - 1) == F.col("outer"))
            bins = part.groupBy("skey", "part").agg(F.sum("size").alias("words"), F.first(f"left{k}").alias("left"), (F.lit(0) if edge is None else F.first("before")).alias("base"))
            after = F.col("base") + F.sum("words").over(Window.partitionBy("skey").orderBy("part"))
            bins = bins.withColumn("after", after)
            every = bins.groupBy("skey").agg(F.max("after").alias("every")) if every is None else every
            edge = bins.where(F.col("after") > F.col("left")).groupBy("skey").agg(F.min_by(F.struct("part", (F.col("after") - F.col("words")).alias("before"), "left"), "part").alias("edge")).select("skey", "edge.*")
            edge = scratch.write(edge, f"edge{k}-{level}")
        edge = edge.withColumnRenamed("part", "bin")
        inside = open_rows.select("skey", "bin", "rank", "oid", "size").join(edge, ["skey", "bin"])
        inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("skey").orderBy("rank", "oid")))
        last = inside.groupBy("skey").agg(
            F.first("bin").alias(f"bin{k}"),
            F.max(F.when(F.col("sum") <= F.col("left"), F.struct("rank", "oid"))).alias("last"),
            F.coalesce(F.max(F.when(F.col("sum") <= F.col("left"), F.col("sum"))), F.first("before")).alias("got"),
        )
        last = last.select("skey", f"bin{k}", F.col("last.rank").alias(f"rank{k}"), F.col("last.oid").alias(f"id{k}"), "got")
        cuts = cuts.join(last, "skey", "left").join(every, "skey", "left")
        cuts = cuts.withColumn(f"left{k + 1}", F.col(f"left{k}") - F.coalesce("got", "every", F.lit(0))).drop("got", "every")
        cuts = scratch.write(cuts, f"cuts{k}")
    return cuts


def copies(rows: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with source_size, target and the copies taken of each."""
    taken = F.col("certain") + _taken(1 + FILLS).cast("long")
    return _ranked(rows, cuts, mix).withColumn("copies", taken)


def mix_documents(docs: DataFrame, scratch: Scratch, mix: Mix = Mix()) -> DataFrame:
    """The mix: rows of ``docs`` with their own columns, each repeated as often as it is taken.

    A null source is a source of its own, null and empty texts have no words and are taken with the certain
    copies only; rows that repeat an id share one random number and one fate. The sources' words are within
    one small document of their targets.
    """
    rows = scratch.write(slim(docs, mix), "rows")
    cuts = cut(rows, mix, scratch)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    carried = docs.select(whole.alias("doc"))
    keyed = carried.select("doc", F.col("doc.doc_id"), source_key(F.col("doc.source")).alias("skey"), n_words(F.col("doc.text")).alias("size"), random_unit(F.col("doc.doc_id"), mix.seed).alias("u"))
    often = copies(keyed, cuts, mix).where("copies > 0")
    return often.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken for every document."""
    mix, scratch = Mix(), Scratch(spark, "op1")
    rows = scratch.write(slim(documents(spark, sf_dir), mix), "rows")
    got = copies(rows, cut(rows, mix, scratch), mix)
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def oracle(fills: int = FILLS) -> str:
    """The same mix in DuckDB SQL, with each source sorted whole."""
    sql = f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
    l AS (SELECT *, row_number() OVER o AS place, ((sum(source_size) OVER ())::BIGINT - coalesce((sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
        FROM w WINDOW o AS (ORDER BY ({MOST} * source_size)::DOUBLE / weight, source IS NOT NULL, source)),
    t AS (SELECT source, source_size, coalesce(least(({MOST} * source_size)::DOUBLE, (SELECT arg_min(level, place) FROM l WHERE level * weight <= {MOST} * source_size) * weight), 0.0) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS ratio FROM t),
    c AS (SELECT *, least(floor(ratio), {MOST})::BIGINT AS certain, greatest(ratio - floor(ratio), 1e-12) AS p FROM e),
    r0 AS (SELECT d.doc_id, d.size, c.source, source_size, target, certain, (u / (1.0 - u)) / (p / (1.0 - p)) AS rank, coalesce(doc_id, -9223372036854775808) AS oid,
        target - (certain * source_size)::DOUBLE AS gap, 0 AS got FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),"""
    for k in range(1 + fills):
        fits = "size > 0" if k == 0 else "size > 0 AND size <= gap"
        sql += f"""
    a{k} AS (SELECT *, (certain < {MOST} AND got = 0 AND {fits}) AS can FROM r{k}),
    b{k} AS (SELECT *, sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN can THEN 0 ELSE 1 END, rank, oid) AS run FROM a{k}),
    f{k} AS (SELECT *, CASE WHEN can AND run <= gap THEN 1 ELSE 0 END AS now FROM b{k}),
    r{k + 1} AS (SELECT doc_id, size, source, source_size, target, certain, rank, oid, gap - sum(now * size) OVER (PARTITION BY source) AS gap, got + now AS got FROM f{k}),"""
    return sql.rstrip(",") + f"\n    SELECT doc_id, size, source_size, target, ((certain + got) * size)::BIGINT AS taken FROM r{1 + fills}"
