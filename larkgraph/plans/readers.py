"""Registry ids, files read by line, record and envelope, and snapshots; the files are written from the given tables first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.registries import REGISTRIES, main_id, registry_ids
from ..session import table
from ..sinks.snapshot import Snapshots
from ..sources import lines as ln
from ..sources import records
from .registry import query


def _folder(spark, name):
    """A new folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="larkgraph-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sentences with ids of many registries, by the order's key.
SENTENCES = (
    "'EudraCT 2021-' || k6 || '-32'",
    "'2022-5' || right(k6, 5) || '-41-00 and DRKS' || k8",
    "'ISRCTN ' || k8 || '; ISRCTN' || k8",
    "'CTRI/2019/01/' || k6 || ', ACTRN' || k8 || '123456'",
    "'NCT' || k8 || ' / 2015-' || k6 || '-12'",
    "'U1111-1332-5367 IRB-2019-77'",
    "'JapicCTI- ' || k6 || '; UMIN 0' || k8",
    "'NL-OMON' || k || ' NTR' || right(k6, 4) || ' KCT' || right(k8, 7)",
    "'jRCTs' || k8 || '1 RBR-' || k6 || 'x'",
    "'ChiCTR-TRC-' || k8 || ' xNCT' || k8 || ' IRCT' || k8 || 'N1'",
    "'PACTR2019' || k6 || '12345 TCTR2019' || right(k6, 5) || '12 SLCTR/2019/' || right(k6, 3)",
    "'RPCEC' || k8 || ' LBCTR20' || k8 || ' 2022-5' || right(k6, 5) || '-41-00-2021-' || k6 || '-32'",
)
KEYS = "lpad(o_orderkey::VARCHAR, 8, '0') AS k8, right(lpad(o_orderkey::VARCHAR, 8, '0'), 6) AS k6, o_orderkey::VARCHAR AS k"
TEXT = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SENTENCES)) + " END"
FOUND = " UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS p, '{name}:' AS name, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', 1) AS local FROM x WHERE regexp_matches(t, '{pattern}')" for i, (name, pattern) in enumerate(REGISTRIES)
)


def sentences(spark, sf_dir):
    k8 = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    keys = table(spark, sf_dir, "orders").select("o_orderkey", k8.alias("k8"), F.substring(k8, 3, 6).alias("k6"), F.col("o_orderkey").cast("string").alias("k"))
    return keys.select("o_orderkey", F.expr(TEXT).alias("t"))


@query("fn_17", f"""WITH x AS MATERIALIZED (SELECT o_orderkey, {TEXT} AS t FROM (SELECT o_orderkey, {KEYS} FROM orders)), f AS ({FOUND}),
    s AS (SELECT o_orderkey, p, j, name || replace(local[j], ' ', '') AS id, list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1 : j - 1], lambda g: length(g))), 0) AS a, length(whole[j]) AS n FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS j FROM f)),
    l AS (SELECT o_orderkey, list({{'id': id, 'a': a, 'b': a + n}} ORDER BY p, j) AS spans FROM s GROUP BY 1),
    k AS (SELECT o_orderkey, list_reduce(list_transform(spans, lambda z: [z]), lambda acc, z: CASE WHEN len(list_filter(acc, lambda y: y.a < z[1].b AND z[1].a < y.b)) > 0 THEN acc ELSE acc || z END) AS kept FROM l)
    SELECT o_orderkey, array_to_string(list_transform(list_filter(kept, lambda z, i: NOT list_contains(list_transform(kept[1 : i - 1], lambda y: y.id), z.id)), lambda z: z.id), ' ') AS ids FROM k""")
def fn_17(spark, sf_dir):
    """Registry ids in sentences; an EU CT number is no EudraCT number, and each id counts once."""
    return sentences(spark, sf_dir).select("o_orderkey", F.array_join(registry_ids(F.col("t")), " ").alias("ids")).where("ids <> ''")


MAIN = ("'EUCTR2021-' || k6 || '-32-DE'", "'CTIS2022-5' || right(k6, 5) || '-41-00'", "'NCT' || k8", "'NCT' || k8 || ' DRKS' || k8", "'EUCTRx'", "'nothing'")


@query("fn_18_main", f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'EUDRACT:2021-' || k6 || '-32' WHEN 1 THEN 'EUCT:2022-5' || right(k6, 5) || '-41-00' WHEN 2 THEN 'NCT:NCT' || k8 END AS main FROM (SELECT o_orderkey, {KEYS} FROM orders)")
def fn_18_main(spark, sf_dir):
    """The registration that a portal's id stands for."""
    k8 = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    keys = table(spark, sf_dir, "orders").select("o_orderkey", k8.alias("k8"), F.substring(k8, 3, 6).alias("k6"))
    text = F.expr("CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(MAIN)) + " END")
    return keys.withColumn("t", text).select("o_orderkey", main_id(F.col("t")).alias("main"))


@query("src_11", "SELECT o_orderkey // 2500 AS part, 'o' || o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey // 2500 ORDER BY o_orderkey) AS line, sha256('{\"id\":\"o' || o_orderkey || '\",\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"}') AS sha256 FROM orders")
def src_11(spark, sf_dir):
    """Lines of JSON files, half of them packed, with their numbers and digests."""
    path = _folder(spark, "jsonl")
    value = F.concat(F.lit('{"id":"o'), "o_orderkey", F.lit('","day":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}'))
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2500).alias("part"), "o_orderkey", value.alias("value"))
    rows = rows.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey")
    for packed in (0, 1):
        rows.where(F.col("part") % 2 == packed).write.partitionBy("part").option("compression", ("none", "gzip")[packed]).text(f"{path}/{packed}")
    got = ln.json_lines(spark, path)
    return got.select(F.regexp_extract("file", "part=(\\d+)", 1).cast("long").alias("part"), "id", "line", "sha256")


@query("src_10", "SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS index, 's' || s_suppkey AS id, sha256('{\"id\":\"s' || s_suppkey || '\",\"n\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}') AS sha256, true AS verified FROM supplier")
def src_10(spark, sf_dir):
    """Records of JSON envelopes, one for each nation, whose checksums are verified."""
    path = _folder(spark, "envelopes")
    record = F.concat(F.lit('{"name":"'), "s_name", F.lit('","id":"s'), "s_suppkey", F.lit('","n":'), "s_suppkey", F.lit("}"))
    canonical = F.concat(F.lit('{"id":"s'), "s_suppkey", F.lit('","n":'), "s_suppkey", F.lit(',"name":"'), "s_name", F.lit('"}'))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", c))), lambda x: x[c]), ","), F.lit("]"))
    by = table(spark, sf_dir, "supplier").withColumns({"r": record, "c": canonical}).groupBy("s_nationkey").agg(listed("r").alias("records"), F.sha2(listed("c").cast("binary"), 256).alias("sum"))
    body = F.concat(F.lit('{"schema":"suppliers","version":2,"header":{"sha256":"'), "sum", F.lit('"},\n "records":'), "records", F.lit("}"))
    by.select("s_nationkey", body.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").option("maxRecordsPerFile", 1).text(path)
    got = ln.envelopes(spark, path, "suppliers", (1, 2))
    return got.select(F.regexp_extract("file", "s_nationkey=(\\d+)", 1).cast("int").alias("s_nationkey"), "index", "id", "sha256", "verified")


@query("src_04", "SELECT 'ORPHA:' || o_orderkey AS id, l_suppkey::VARCHAR AS symbol, CASE l_returnflag WHEN 'A' THEN 'Disease-causing germline mutation(s) in' ELSE 'Role in the phenotype of' END AS association, l_linestatus AS status, 'PMID:' || l_partkey AS source FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def src_04(spark, sf_dir):
    """Gene associations of disorders, written as XML elements and read by their tag."""
    path = _folder(spark, "disorders")
    lines = table(spark, sf_dir, "lineitem")
    named = lambda c: F.struct(F.struct(F.lit("en").alias("_lang"), c.alias("_VALUE")).alias("Name"))

    def gene(row):  # keys go through the shuffle; elements are worded where they are written
        kind = F.when(row["l_returnflag"] == "A", "Disease-causing germline mutation(s) in").otherwise("Role in the phenotype of")
        return F.struct(F.concat(F.lit("PMID:"), row["l_partkey"]).alias("SourceOfValidation"), F.struct(row["l_suppkey"].cast("string").alias("Symbol")).alias("Gene"), named(kind).alias("DisorderGeneAssociationType"), named(row["l_linestatus"]).alias("DisorderGeneAssociationStatus"))

    by = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("rows"))
    rows = table(spark, sf_dir, "orders").join(by, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("OrphaCode"), F.struct(F.lit("en").alias("_lang"), F.col("o_orderpriority").alias("_VALUE")).alias("Name"), F.struct(F.transform("rows", gene).alias("DisorderGeneAssociation")).alias("DisorderGeneAssociationList"))
    rows.write.format("xml").option("rootTag", "JDBOR").option("rowTag", "Disorder").option("compression", "gzip").save(path)
    return records.Disorders(spark, path).genes()


@query("src_01", """SELECT 'P:' || p_partkey AS id, p_name AS name, p_type || ' "' || p_brand || '"' AS synonym, CASE p_size % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'RELATED' ELSE 'BROAD' END AS scope, CASE p_size % 3 WHEN 0 THEN 'layperson' END AS kind, 'B:' || replace(p_brand, '#', '') AS parent, 'X:' || p_size AS xref, 's' || p_partkey AS source, p_size % 7 = 0 AS obsolete FROM part""")
def src_01(spark, sf_dir):
    """Terms of a file of stanzas: names, quoted synonyms with scope and kind, parents, references with their sources."""
    path = _folder(spark, "terms")
    size = F.col("p_size") % 3
    rest = F.when(size == 0, ' EXACT layperson [A:1, "x"]').when(size == 1, "").otherwise(" BROAD []")
    put = lambda *parts: F.concat(*(F.lit(p) if p is not None and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts))
    stanza = F.concat_ws(
        "\n",
        F.lit("[Term]"),
        put("id: P:", "$p_partkey"),
        put("name: ", "$p_name"),
        F.concat(F.lit('synonym: "'), "p_type", F.lit(' \\"'), "p_brand", F.lit('\\""'), rest),
        F.concat(F.lit("is_a: B:"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" ! a brand")),
        put("xref: X:", "$p_size", ' {source="s', "$p_partkey", '"}'),
        F.when(F.col("p_size") % 7 == 0, "is_obsolete: true"),
        F.lit(""),
    )
    table(spark, sf_dir, "part").select(stanza.alias("value")).write.text(path)
    got = records.obo_terms(spark, path)
    s, x = F.get("synonyms", 0), F.get("xrefs", 0)
    return got.select("id", "name", s["text"].alias("synonym"), s["scope"].alias("scope"), s["kind"].alias("kind"), F.get("parents", 0).alias("parent"), x["id"].alias("xref"), F.get(x["sources"], 0).alias("source"), "obsolete")


@query("snk_01", "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snk_01(spark, sf_dir):
    """A table built once and read from its snapshot, which is fresh as long as its input is."""
    store = Snapshots(spark, _folder(spark, "snapshots"))
    path = f"{sf_dir}/orders.parquet"
    build = lambda: {"customers": table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))}

    def again():
        raise AssertionError("the input has not changed")

    store.fresh([path], build)
    return store.fresh([path], again)["customers"]
