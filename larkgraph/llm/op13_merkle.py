"""A Merkle manifest of a dataset: one digest for all rows, one for each source, and a proof for each row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its count of UTF-8 bytes, ``:`` and the value.
The leaves of a source, by id, are hashed in runs of three until one node is left, the source's subroot; the
subroots, by source, give the root in the same way.

The tree is built from the bottom: places come from an exchange by range and counts of each range, so no task
sees a whole source; then each level groups its nodes by place div 3 and is written with its children in it.
Proofs go down: a level's rows join their parents' proofs by place, and each child puts its siblings before the proof that
it inherits. Only parents are joined, so the longest proofs move once for three rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:binary,right:binary>>"


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def hexed(node: Column) -> Column:
    """Digests are kept as bytes; they enter hashes as lower-case hex text."""
    return F.lower(F.hex(node))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of them given as other columns."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*(part(name) for name in FIELDS))


def ranked(rows: DataFrame, scratch: Scratch, name: str, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with each row's place among those of its ``grp`` and their number ``n``; and the largest number.

    Rows are dealt by ranges of (grp, order), so a group of any size is spread; only a row for each range and group is
    summed by a window.
    """
    keys = [F.col(k).asc_nulls_first() for k in ("grp", *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An id that grows within a partition: its upper bits are the partition, its lower 33 the row.
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.write(dealt, f"{name}-ranges").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.write(runs.select("grp", "part", "first", before.alias("before"), F.sum("rows").over(own).alias("n")), f"{name}-runs")
    placed = dealt.join(runs, ["grp", "part"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")
    return placed, runs.agg(F.max("n")).first()[0] or 0


def build(nodes: DataFrame, most: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Written levels (grp, pos, n, kids, node) above ``nodes`` (grp, pos, n, kid), whose kids have a digest ``node``.

    ``n`` counts the nodes of the group in that level; a group ends at the level where it has one.
    """
    levels, below = [], nodes
    while most > 1:
        most = -(-most // FAN)
        runs = below.where("n > 1").groupBy("grp", F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        runs = runs.agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "kid"))).alias("run"))
        runs = runs.select("grp", "pos", "n", F.transform("run", lambda x: x["kid"]).alias("kids"))
        node = F.unhex(F.sha2(F.concat_ws("", F.transform("kids", lambda k: hexed(k["node"]))), 256))
        levels.append(scratch.write(runs.withColumn("node", node), f"{name}-{len(levels)}"))
        below = levels[-1].select("grp", "pos", "n", F.struct("node").alias("kid"))
    return levels


def tops(levels: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """(grp, node): what remains of each group; a lone node itself."""
    out = nodes.where("n = 1").select("grp", F.col("kid.node").alias("node"))
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("grp", "node"))
    return out


def proofs(levels: list[DataFrame], nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(grp, kid, steps, ...) of every node: the siblings to its left and right, level by level up to the root.

    ``above`` (grp, steps, ...) continues the proofs of a group's top and adds its other columns; without it they end there.
    """

    def start(rows: DataFrame) -> DataFrame:
        return rows.withColumn("steps", F.array().cast(STEPS)) if above is None else rows.join(above, "grp")

    inherited = None
    more = [c for c in above.columns if c not in ("grp", "steps")] if above is not None else []
    for level in reversed(levels):
        ends = start(level.where("n = 1").select("grp", "pos")).select("grp", "pos", "steps", *more)
        inherited = ends if inherited is None else inherited.select("grp", "pos", "steps", *more).unionByName(ends)
        kids = level.select("grp", "pos", "kids").join(inherited, ["grp", "pos"])
        kids = kids.select("grp", "pos", "steps", *more, F.transform("kids", lambda k: k["node"]).alias("run"), F.posexplode("kids").alias("i", "kid"))

        def joined(run: Column) -> Column:
            return F.aggregate(run, F.lit(b""), lambda a, x: F.concat(a, x))

        step = F.struct(joined(F.slice("run", F.lit(1), F.col("i"))).alias("left"), joined(F.slice("run", F.col("i") + 2, F.size("run"))).alias("right"))
        place = (F.col("pos") * FAN + F.col("i")).alias("pos")
        inherited = kids.select("grp", place, F.concat(F.array(step), "steps").alias("steps"), *more, "kid")
    lone = start(nodes.where("n = 1").select("grp", "kid")).select("grp", "steps", *more, "kid")
    return lone if inherited is None else inherited.select("grp", "steps", *more, "kid").unionByName(lone)


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""
    return F.aggregate(steps, node, lambda a, s: digest(hexed(s["left"]), a, hexed(s["right"])))


def proof_digest(steps: Column) -> Column:
    """H of the siblings, level by level, left to right; of nothing, where a row has none."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))), 256)


def manifest(docs: DataFrame, scratch: Scratch, **carried: Column) -> DataFrame:
    """doc_id, leaf, subroot, root (hex), steps and the ``carried`` columns of every row of ``docs``.

    A null or empty field is part of the leaf like any other. Rows without an id come first in their source, rows
    without a source are a source of their own, before the others. Rows that share an id stand by their leaves;
    repeated rows are leaves of their own, side by side. Other columns play no part, and an empty table gives no rows.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, then by bytes
    slim = docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf()).alias("node"), *(c.alias(k) for k, c in carried.items()))
    # Written before it is dealt: sampling the ranges then reads digests, not texts. ``row`` parts repeated rows.
    slim = scratch.write(slim.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed, most = ranked(slim, scratch, "leaves", "doc_id", "node", "row")
    nodes = placed.select("grp", "pos", "n", F.struct("doc_id", *carried, "node").alias("kid"))
    levels = build(nodes, most, scratch, "level")

    roots = tops(levels, nodes).select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("node"))
    sources, most = ranked(scratch.write(roots, "subroots"), scratch, "sources", "source")
    sources = sources.select("grp", "pos", "n", F.struct("source", "node").alias("kid"))
    upper = build(sources, most, scratch, "upper")
    root = tops(upper, sources).select(hexed(F.col("node"))).first()
    above = proofs(upper, sources).select(F.col("kid.source").alias("grp"), "steps", F.col("kid.node").alias("subroot"))
    out = proofs(levels, nodes, scratch.write(above, "above"))
    return out.select("kid.doc_id", hexed(F.col("kid.node")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), "steps", *(F.col(f"kid.{c}").alias(c) for c in carried))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a copy that lost its line breaks still verifies."""
    docs = documents(spark, sf_dir)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = even & F.contains("text", F.lit("\n"))
    held = F.when(tampered, F.unhex(leaf(text=F.replace("text", F.lit("\n"), F.lit("")))))
    rows = manifest(docs, Scratch(spark, "op13"), held=held)
    rows = rows.withColumn("folded_root", fold(F.coalesce(hexed(F.col("held")), "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


# The tree as lists of digests a source and level; a document's fold walks up by its place. CRC-32 is worked out bit by bit.
ORACLE = f"""
    WITH RECURSIVE bits AS (SELECT n, list_reduce([n] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(n)),
    tab AS (SELECT list(v ORDER BY n) AS t FROM bits),
    d AS MATERIALIZED (SELECT doc_id, source, sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
        CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0
            THEN sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))} || {_field("replace(text, chr(10), '')")}) END AS held
        FROM documents, tab),
    lv AS (SELECT source, 0 AS k, list(leaf ORDER BY doc_id) AS nodes FROM d GROUP BY source
        UNION ALL SELECT source, k + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM lv WHERE len(nodes) > 1),
    sub AS MATERIALIZED (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth FROM lv WHERE len(nodes) = 1),
    up AS (SELECT 0 AS k, list(subroot ORDER BY nth) AS nodes FROM sub
        UNION ALL SELECT k + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM up WHERE len(nodes) > 1),
    root AS (SELECT nodes[1] AS root FROM up WHERE len(nodes) = 1),
    low AS (SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, 0 AS k, coalesce(held, leaf) AS f, '' AS p FROM d
        UNION ALL SELECT doc_id, low.source, leaf, pos // 3, low.k + 1,
            sha256(array_to_string(list_transform(range(3 * (pos // 3), least(3 * (pos // 3) + 3, len(nodes))), lambda i: CASE WHEN i = pos THEN f ELSE nodes[i + 1] END), '')),
            p || array_to_string(list_transform(list_filter(range(3 * (pos // 3), least(3 * (pos // 3) + 3, len(nodes))), lambda i: i <> pos), lambda i: nodes[i + 1]), '')
            FROM low JOIN lv ON lv.source IS NOT DISTINCT FROM low.source AND lv.k = low.k WHERE len(nodes) > 1),
    mid AS MATERIALIZED (SELECT DISTINCT ON (doc_id) doc_id, leaf, subroot, nth, f, p FROM low JOIN sub ON sub.source IS NOT DISTINCT FROM low.source ORDER BY doc_id, k DESC),
    top AS (SELECT doc_id, leaf, subroot, nth AS pos, 0 AS k, f, p FROM mid
        UNION ALL SELECT doc_id, leaf, subroot, pos // 3, top.k + 1,
            sha256(array_to_string(list_transform(range(3 * (pos // 3), least(3 * (pos // 3) + 3, len(nodes))), lambda i: CASE WHEN i = pos THEN f ELSE nodes[i + 1] END), '')),
            p || array_to_string(list_transform(list_filter(range(3 * (pos // 3), least(3 * (pos // 3) + 3, len(nodes))), lambda i: i <> pos), lambda i: nodes[i + 1]), '')
            FROM top JOIN up ON up.k = top.k WHERE len(nodes) > 1)
    SELECT DISTINCT ON (doc_id) doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM top, root ORDER BY doc_id, k DESC
"""
