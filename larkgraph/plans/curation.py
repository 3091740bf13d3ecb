"""Curated values: effects, tiers, kinds, identifiers, and the filters and joins over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.ranking import rank_among
from ..operators.stored import side
from ..session import table
from ..sources import star
from .registry import query


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _held(spark, sf_dir, where: str = "true"):
    """Lines with the entity that ordered them."""
    return _lines(spark, sf_dir).join(table(spark, sf_dir, "orders").where(where), F.col("l_orderkey") == F.col("o_orderkey"))


@query("fn_08", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN '2' END AS date FROM lineitem")
def fn_08(spark, sf_dir):
    """Last bracketed date of each curation note; some hold two brackets, some none."""
    k, day = F.col("l_linenumber") % 3, F.date_format("l_shipdate", "yyyy-MM-dd")
    note = F.when(k == 0, F.concat(F.lit("HPO:a[1999-01-01];HPO:b["), day, F.lit("] x"))).when(k == 1, F.lit("a[[2]")).otherwise("none")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", t.annotation_date(note).alias("date"))


ASSOCIATION = "CASE p_size % 5 WHEN 0 THEN 'MENDELIAN' WHEN 1 THEN 'Disease-causing germline mutation(s) (loss of function) in' WHEN 2 THEN 'Disease-causing germline mutation(s) (gain of function) in' WHEN 3 THEN 'Candidate gene tested in' ELSE 'dominant negative' END"


@query("fn_09", f"WITH a AS (SELECT p_partkey, {ASSOCIATION} AS a, CASE WHEN p_size % 7 = 0 THEN 'G2P' ELSE 'Orphanet' END AS s FROM part) SELECT p_partkey, a = 'MENDELIAN' OR starts_with(a, 'Disease-causing germline') OR s = 'G2P' AS causal, CASE WHEN contains(lower(a), 'loss of function') THEN 'LoF' WHEN contains(lower(a), 'gain of function') THEN 'GoF' WHEN contains(lower(a), 'dominant negative') THEN 'DN' ELSE 'unknown' END AS effect FROM a")
def fn_09(spark, sf_dir):
    """Causal links and the effect that an association names."""
    a, s = F.expr(ASSOCIATION), F.when(F.col("p_size") % 7 == 0, "G2P").otherwise("Orphanet")
    return table(spark, sf_dir, "part").select("p_partkey", t.is_causal(a, s).alias("causal"), t.variant_effect(a).alias("effect"))


@query("fn_10", f"{star.with_views('ann')} SELECT entity, term, CASE WHEN m = 1 AND iea THEN 'unknown' WHEN n / m::DOUBLE >= 1 THEN 'obligate' WHEN n / m::DOUBLE >= 0.8 THEN 'very_frequent' WHEN n / m::DOUBLE >= 0.3 THEN 'frequent' WHEN n / m::DOUBLE >= 0.05 THEN 'occasional' WHEN n > 0 THEN 'very_rare' ELSE 'zero_observed' END AS tier FROM ann")
def fn_10(spark, sf_dir):
    """Frequency tier of each annotation; one computed observation says nothing."""
    best = F.when(~((F.col("m") == 1) & F.col("iea")), F.col("n") / F.col("m"))
    return star.annotations(spark, sf_dir).select("entity", "term", t.frequency_tier(best).alias("tier"))


MECHANISM = "['loss of function', 'gain of function', 'dominant negative', 'undetermined']"


@query("fn_11", f"WITH m AS (SELECT x, CASE x WHEN 'loss of function' THEN 'LoF' WHEN 'gain of function' THEN 'GoF' WHEN 'dominant negative' THEN 'DN' END AS e FROM (SELECT unnest({MECHANISM}) AS x)), p AS (SELECT p_partkey, {MECHANISM}[p_size % 4 + 1] AS a, {MECHANISM}[p_partkey % 4 + 1] AS b FROM part) SELECT p_partkey, x.e AS a, y.e AS b, coalesce((x.e IN ('LoF', 'DN') AND y.e = 'GoF') OR (y.e IN ('LoF', 'DN') AND x.e = 'GoF'), false) AS opposite FROM p JOIN m x ON x.x = p.a JOIN m y ON y.x = p.b")
def fn_11(spark, sf_dir):
    """Effects of mechanism columns, and whether two are opposite."""
    words = F.array(*map(F.lit, (*t.EFFECTS.values(), "undetermined")))
    a, b = (t.effect_of_mechanism(F.get(words, F.col(c) % 4)) for c in ("p_size", "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"), t.opposite_effects(a, b).alias("opposite"))


@query("fn_13", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'trial' WHEN 'P' THEN 'expanded_access' ELSE CASE WHEN o_orderkey % 11 = 0 OR o_orderpriority = '1-URGENT' THEN 'registry' WHEN o_orderpriority = '2-HIGH' THEN 'natural_history' ELSE 'observational' END END AS kind FROM orders")
def fn_13(spark, sf_dir):
    """Kinds of studies by type, registry flag and the words of their titles."""
    type_ = F.when(F.col("o_orderstatus") == "O", "INTERVENTIONAL").when(F.col("o_orderstatus") == "P", "EXPANDED_ACCESS").otherwise("OBSERVATIONAL")
    title = F.when(F.col("o_orderpriority") == "1-URGENT", "A patient REGISTRY").when(F.col("o_orderpriority") == "2-HIGH", "Natural History of x").otherwise("A cohort")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.study_kind(type_, title, F.col("o_orderkey") % 11 == 0).alias("kind"))


@query("fn_18", "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 8 = 3 THEN 'nct ' || lpad(p_partkey::VARCHAR, 8, '0') ELSE CASE p_size % 4 WHEN 0 THEN p_partkey || '-' || p_size WHEN 1 THEN ' protocol ' WHEN 2 THEN 'ab ' || p_brand ELSE 'x' || p_size END END AS raw FROM part), k AS (SELECT p_partkey, upper(regexp_replace(raw, '\\s+', '', 'g')) AS k FROM p) SELECT p_partkey, CASE WHEN length(k) < 6 OR regexp_full_match(k, '[0-9.-]*') OR regexp_matches(k, '\\bNCT\\d{8}\\b') OR k IN ('NONE', 'N/A', 'NA', 'PROTOCOL', 'PILOT', 'STUDY', 'IRB', '1.0') THEN NULL ELSE k END AS protocol FROM k")
def fn_18(spark, sf_dir):
    """Protocol numbers that can tell studies apart; a registry's id is none."""
    k, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat_ws("-", "p_partkey", "p_size")).when(k == 1, " protocol ").when(k == 2, F.concat(F.lit("ab "), "p_brand")).otherwise(F.concat(F.lit("x"), size))
    raw = F.when(F.col("p_size") % 8 == 3, F.concat(F.lit("nct "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", t.protocol_key(raw).alias("protocol"))


KEYS = "rows AS (SELECT unnest(['qwertyuiop', 'asdfghjkl', 'zxcvbnm', 'qwertzuiop', 'yxcvbnm']) AS r), near AS (SELECT DISTINCT unnest([r[i:i] || r[i + 1 : i + 1], r[i + 1 : i + 1] || r[i:i]]) AS k FROM (SELECT r, unnest(range(1, length(r))) AS i FROM rows))"


@query("fn_24", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), {KEYS}, p AS (SELECT a.w AS a, b.w AS b, list_filter(range(1, length(a.w) + 1), lambda i: a.w[i:i] <> b.w[i:i]) AS d FROM w a JOIN w b ON a.w < b.w AND length(a.w) = length(b.w)) SELECT a, b FROM p WHERE len(d) = 1 AND a[d[1] : d[1]] || b[d[1] : d[1]] IN (SELECT k FROM near)")
def fn_24(spark, sf_dir):
    """Words of one length that differ by one neighbouring key."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    keyed = words.withColumn("key", F.explode(F.array_distinct(t.deletions(F.col("w")))))
    a, b = (keyed.select("key", F.col("w").alias(c)) for c in ("a", "b"))
    same = (F.col("a") < F.col("b")) & (F.length("a") == F.length("b"))
    return a.join(b, "key").where(same).select("a", "b").distinct().where(t.keyboard_neighbours(F.col("a"), F.col("b")))


@query("fn_33", "SELECT page_id, replace(replace(url_encode(url), '+', '%20'), '*', '%2A') AS iri, length(replace(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')) + 2 AS literal_chars FROM pages")
def fn_33(spark, sf_dir):
    """Encoded addresses, and the length of each page as a literal."""
    return table(spark, sf_dir, "pages").select("page_id", t.iri_encode(F.col("url")).alias("iri"), F.length(t.turtle_literal(F.col("html"))).cast("long").alias("literal_chars"))


@query("fn_36", "SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Bonjour ' || c_name || ', ' || c_mktsegment ELSE 'Hello ' || c_name || ' of ' || c_mktsegment END AS message FROM customer")
def fn_36(spark, sf_dir):
    """Messages by locale; a locale without the message takes the English one."""
    rows = [("en", "hello", "Hello {name} of {segment}"), ("fr", "hello", "Bonjour {name}, {segment}")]
    catalogue = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("locale"), F.lit(b).alias("message"), F.lit(c).alias("template")) for a, b, c in rows))).alias("m")).select("m.*")
    own = table(spark, sf_dir, "customer").withColumn("want", F.when(F.col("c_nationkey") % 3 == 0, "fr").otherwise("it"))
    found = own.join(F.broadcast(catalogue.where("message = 'hello'")), F.col("locale") == F.col("want"), "left")  # as many rows as locales
    template = F.coalesce("template", F.lit(rows[0][2]))
    return found.select("c_custkey", t.render_message(template, {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("message"))


@query("fl_01", "SELECT p_partkey, p_partkey % 3 = 0 AND p_size > 40 AS newly FROM part WHERE p_size % 10 <> 0")
def fl_01(spark, sf_dir):
    """Active parts, and which of them are newly described."""
    marks = F.array_compact(F.array(F.when(F.col("p_partkey") % 3 == 0, "third"), F.when(F.col("p_size") > 40, "large")))
    active = table(spark, sf_dir, "part").where("p_size % 10 <> 0")
    return active.select("p_partkey", (F.exists(marks, lambda x: x == "third") & F.exists(marks, lambda x: x == "large")).alias("newly"))


ITEMS = "items AS (SELECT 'study' AS kind, 'O:' || o_orderkey AS id, c_nationkey AS country, o_orderstatus = 'O' AS recruiting FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'person', 'S:' || s_suppkey, s_nationkey, NULL FROM supplier UNION ALL SELECT 'document', 'P:' || p_partkey, NULL, NULL FROM part)"


def items(spark, sf_dir):
    """(kind, id, country, recruiting): studies have both facets, people a country, documents none."""
    studies = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    studies = studies.select(F.lit("study").alias("kind"), F.concat(F.lit("O:"), "o_orderkey").alias("id"), F.col("c_nationkey").alias("country"), (F.col("o_orderstatus") == "O").alias("recruiting"))
    none = F.lit(None)
    people = table(spark, sf_dir, "supplier").select(F.lit("person").alias("kind"), F.concat(F.lit("S:"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("country"), none.cast("boolean").alias("recruiting"))
    papers = table(spark, sf_dir, "part").select(F.lit("document").alias("kind"), F.concat(F.lit("P:"), "p_partkey").alias("id"), none.cast("long").alias("country"), none.cast("boolean").alias("recruiting"))
    return studies.unionByName(people).unionByName(papers)


def accepts(country: int | None = None, recruiting: bool | None = None, skip: str = ""):
    """Whether an item passes; a facet is asked only of kinds that carry it, and ``skip`` leaves one out."""
    out = F.lit(True)
    if country is not None and skip != "country":
        out = out & (~F.col("kind").isin("study", "person") | F.coalesce(F.col("country") == country, F.lit(False)))
    if recruiting is not None and skip != "recruiting":
        out = out & ((F.col("kind") != "study") | F.coalesce(F.col("recruiting") == recruiting, F.lit(False)))
    return out


@query("fl_02", f"WITH {ITEMS} SELECT kind, count(*) AS items, count(*) FILTER (kind = 'document' OR (country = 3 AND (kind <> 'study' OR recruiting))) AS accepted, count(*) FILTER (kind <> 'study' OR recruiting) AS without_country FROM items GROUP BY 1")
def fl_02(spark, sf_dir):
    """Items that two facets accept, and those that they accept without the country."""
    count = lambda skip: F.count_if(accepts(3, True, skip))
    return items(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("items"), count("").alias("accepted"), count("country").alias("without_country"))


@query("fl_03", f"WITH {ITEMS} SELECT kind, id FROM items WHERE (kind = 'study' AND recruiting AND country < 3) OR (kind = 'person' AND country < 3)")
def fl_03(spark, sf_dir):
    """What an intent wants: open studies and people, of some countries."""
    wanted = F.when(F.col("kind") == "study", F.col("recruiting")).when(F.col("kind") == "person", True).otherwise(False)
    return items(spark, sf_dir).where(wanted & (F.col("country") < 3)).select("kind", "id")


@query("fl_06", "WITH o AS (SELECT o_orderkey AS id, list_sort(list('S:' || l_suppkey)) AS links FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT id, list_filter(links, lambda x: x <> 'S:7') AS links FROM o WHERE id % 100 <> 7")
def fl_06(spark, sf_dir):
    """Responses without what a withheld token names: whole objects, and items of lists."""
    rows = _held(spark, sf_dir).groupBy(F.col("o_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("S:"), "l_suppkey"))).alias("links"))
    return rows.where(F.col("id") % 100 != 7).select("id", F.filter("links", lambda x: x != "S:7").alias("links"))


LADDER = "CASE WHEN l_linenumber = 7 THEN 'source_conflict' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'unknown_justification' WHEN l_partkey % 10 = 0 THEN 'invalid_identifier' WHEN l_suppkey % 4 <> l_partkey % 4 AND NOT (l_linenumber = 2) THEN 'incompatible_regime' WHEN l_returnflag = 'A' THEN 'candidate_method' ELSE 'eligible' END"


@query("fl_08", f"SELECT {LADDER} AS reason, count(*) AS rows FROM lineitem GROUP BY 1")
def fl_08(spark, sf_dir):
    """The first reason on the ladder that keeps a mapping from being identity."""
    c = F.col
    reasons = (
        ("source_conflict", c("l_linenumber") == 7),
        ("unknown_justification", (c("l_returnflag") == "N") & (c("l_linestatus") == "F")),
        ("invalid_identifier", c("l_partkey") % 10 == 0),
        ("incompatible_regime", (c("l_suppkey") % 4 != c("l_partkey") % 4) & (c("l_linenumber") != 2)),
        ("candidate_method", c("l_returnflag") == "A"),
    )
    first = F.coalesce(*(F.when(test, name) for name, test in reasons), F.lit("eligible"))
    return _lines(spark, sf_dir).groupBy(first.alias("reason")).agg(F.count("*").alias("rows"))


@query("jn_05", "WITH g AS (SELECT unnest([lower(s_name), 'HGNC:' || s_suppkey, 'NCBI:' || (s_suppkey % 50)]) AS name, s_suppkey FROM supplier) SELECT name, min(s_suppkey) AS gene FROM g GROUP BY 1")
def jn_05(spark, sf_dir):
    """A gene by symbol or either id; the first that bears it wins."""
    s = table(spark, sf_dir, "supplier")
    names = F.array(F.lower("s_name"), F.concat(F.lit("HGNC:"), "s_suppkey"), F.concat(F.lit("NCBI:"), F.col("s_suppkey") % 50))
    return s.select(F.explode(names).alias("name"), "s_suppkey").groupBy("name").agg(F.min("s_suppkey").alias("gene"))


@query("jn_08", "SELECT DISTINCT o_orderkey, p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON 'D' || (p_partkey % 97) = 'D' || (o_custkey % 97) AND p_size = l_linenumber")
def jn_08(spark, sf_dir):
    """Studies and terms that name the same heading and size."""
    mesh = lambda c: (F.col(c) % 97).alias("mesh")
    lines, parts = _lines(spark, sf_dir), table(spark, sf_dir, "part")
    n = lines.count()
    # A study holds each size once, so pairs with a term of one size come out of the join distinct.
    studies = table(spark, sf_dir, "orders").select("o_orderkey", mesh("o_custkey")).repartition("o_orderkey").distinct()
    sizes = lines.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("sizes"))
    own = studies.join(sizes, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "mesh", "sizes")
    terms = parts.groupBy("p_partkey", mesh("p_partkey")).agg(F.collect_set("p_size").alias("all"))
    one = terms.where("size(all) = 1").select("p_partkey", "mesh", F.col("all")[0].alias("size"))
    # Studies of a heading are dealt into slices, which every term meets: a task has few headings and studies, and a study's
    # rows come one behind the other, so that what it writes is a fraction of a byte a row.
    slices = max(1, -(-n // (1 << 24)))
    cut = own.select("o_orderkey", "mesh", F.explode("sizes").alias("size"), F.pmod(F.xxhash64("o_orderkey"), F.lit(slices)).cast("int").alias("slice"))
    each = one.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    cell = ["mesh", "size", "slice"]
    if -(-n // (1 << 16)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        cut, each = (x.repartition(-(-n // (1 << 16)), *cell) for x in (cut, each))
    out = cut.join(side(each), cell).select("o_orderkey", "p_partkey")
    many = terms.where("size(all) > 1")
    if many.isEmpty():
        return out
    # A term of several sizes is met by the least that a study has too.
    both = own.select("o_orderkey", "mesh", "sizes", F.explode("sizes").alias("size")).join(many.select("p_partkey", "mesh", "all", F.explode("all").alias("size")), ["mesh", "size"])
    return out.unionByName(both.where(F.col("size") == F.array_min(F.array_intersect("sizes", "all"))).select("o_orderkey", "p_partkey"))


@query("jn_10", "WITH d AS (SELECT doc_id, source, ' ' || trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) || ' ' AS norm FROM documents), n AS (SELECT * FROM (VALUES ('mit license'), ('general public license'), ('all rights reserved'), ('licensed under')) AS v(name)) SELECT source, name, count(*) AS texts FROM d JOIN n ON contains(norm, ' ' || name || ' ') GROUP BY 1, 2")
def jn_10(spark, sf_dir):
    """Texts that hold a name as whole words."""
    names = F.array(*map(F.lit, ("mit license", "general public license", "all rights reserved", "licensed under")))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), F.lit(" "))
    found = F.filter(names, lambda n: F.contains(norm, F.concat(F.lit(" "), n, F.lit(" "))))
    return table(spark, sf_dir, "documents").select("source", F.explode(found).alias("name")).groupBy("source", "name").agg(F.count("*").alias("texts"))


@query("jn_11", f"""{star.with_views('isa')}, e AS (SELECT e.c AS c, e.p AS p FROM isa), linked AS (SELECT 'B:' || p_brand AS id FROM part WHERE p_size > 48 UNION SELECT 'Y:' || p_type FROM part WHERE p_size > 48),
    up AS (SELECT c AS node, p AS umbrella, 1 AS depth FROM e UNION ALL SELECT a.c, b.p, 2 FROM e a JOIN e b ON a.p = b.c) SELECT node, umbrella, min(depth)::INT AS depth FROM up WHERE umbrella IN (SELECT id FROM linked) AND node LIKE 'P:%' GROUP BY 1, 2""")
def jn_11(spark, sf_dir):
    """Parents and grandparents of each part that have direct links."""
    edges, parts = star.hierarchy(spark, sf_dir), table(spark, sf_dir, "part").where("p_size > 48")
    linked = parts.select(F.explode(F.array(F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("Y:"), "p_type"))).alias("umbrella")).distinct()
    one = edges.select(F.col("child").alias("node"), F.col("parent").alias("umbrella"), F.lit(1).alias("depth"))
    up = edges.select(F.col("child").alias("mid"), F.col("parent").alias("umbrella"))
    two = one.withColumnRenamed("umbrella", "mid").join(up, "mid").select("node", "umbrella", F.lit(2).alias("depth"))
    own = one.unionByName(two).where("node LIKE 'P:%'").join(linked, "umbrella", "left_semi")
    return own.groupBy("node", "umbrella").agg(F.min("depth").alias("depth"))


@query("jn_15", "WITH l AS (SELECT o_custkey AS entity, l_suppkey AS gene, l_partkey AS drug, l_returnflag AS flag, l_linenumber AS line, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey), a AS (SELECT entity, drug, 0 AS route FROM l WHERE flag = 'R' UNION ALL SELECT g.entity, t.drug, 1 FROM (SELECT DISTINCT entity, gene FROM l WHERE flag = 'R' AND line = 1) AS g JOIN (SELECT DISTINCT gene, drug FROM l WHERE line = 2 AND q >= 49) AS t USING (gene)) SELECT entity, drug, CASE min(route) WHEN 0 THEN 'indication' ELSE 'target' END AS route FROM a GROUP BY 1, 2")
def jn_15(spark, sf_dir):
    """Drugs of an entity by indication, else by a target among its genes."""
    lines = _held(spark, sf_dir)
    by = lines.where("l_returnflag = 'R'").select(F.col("o_custkey").alias("entity"), F.col("l_partkey").alias("drug"), F.lit(0).alias("route"))
    genes = lines.where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("o_custkey").alias("entity"), F.col("l_suppkey").alias("gene")).distinct()
    targets = lines.where("l_linenumber = 2 AND l_quantity >= 49").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("drug")).distinct()
    mech = genes.join(targets, "gene").select("entity", "drug", F.lit(1).alias("route"))
    best = by.unionByName(mech).groupBy("entity", "drug").agg(F.min("route").alias("route"))
    return best.select("entity", "drug", F.when(F.col("route") == 0, "indication").otherwise("target").alias("route"))


@query("jn_21", "WITH ids AS (SELECT o_orderkey AS paper, unnest(['pmid:' || (o_orderkey % 4000), 'doi:' || o_custkey]) AS id FROM orders), oa AS (SELECT CASE p_size % 2 WHEN 0 THEN 'pmid:' || p_partkey ELSE 'doi:' || (p_partkey % 1500) END AS id, p_size > 25 AS free, p_partkey AS location FROM part) SELECT paper, count(DISTINCT location) FILTER (free) AS locations, CASE WHEN bool_or(free) THEN 'open' ELSE 'closed' END AS status FROM ids JOIN oa USING (id) GROUP BY 1")
def jn_21(spark, sf_dir):
    """Open copies of papers by either of their ids."""
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("pmid:"), "p_partkey")).otherwise(F.concat(F.lit("doi:"), F.col("p_partkey") % 1500))
    copies = p.select(key.alias("id"), (F.col("p_size") > 25).alias("free"), F.col("p_partkey").alias("location"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.explode(F.array(F.concat(F.lit("pmid:"), F.col("o_orderkey") % 4000), F.concat(F.lit("doi:"), "o_custkey"))).alias("id"))
    own = ids.join(copies, "id").groupBy("paper").agg(F.countDistinct(F.when(F.col("free"), F.col("location"))).alias("locations"), F.bool_or("free").alias("any"))
    return own.select("paper", "locations", F.when(F.col("any"), "open").otherwise("closed").alias("status"))


@query("ag_11", "SELECT o_custkey AS entity, l_returnflag AS kind, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS exact, count(DISTINCT l_partkey) FILTER (l_linestatus <> 'F') AS related FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def ag_11(spark, sf_dir):
    """Exact and related connections of each kind."""
    exact = F.col("l_linestatus") == "F"
    n = lambda c: F.countDistinct(F.when(c, F.col("l_partkey")))
    return _held(spark, sf_dir).groupBy(F.col("o_custkey").alias("entity"), F.col("l_returnflag").alias("kind")).agg(n(exact).alias("exact"), n(~exact).alias("related"))


@query("ag_14", "SELECT l_suppkey AS gene, count(*) FILTER (l_returnflag = 'R') AS pathogenic, count(*) FILTER (l_returnflag = 'A') AS uncertain, count(*) FILTER (l_returnflag = 'N') AS benign, round(count(*) FILTER (l_linenumber <= 3) / count(*)::DOUBLE, 6) AS functional FROM lineitem GROUP BY 1")
def ag_14(spark, sf_dir):
    """Variants of each gene by significance, and the share that is functional."""
    n = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    return _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("gene")).agg(n("R").alias("pathogenic"), n("A").alias("uncertain"), n("N").alias("benign"), F.round(F.count_if(F.col("l_linenumber") <= 3) / F.count("*"), 6).alias("functional"))


@query("ag_16", "WITH r AS (SELECT 'order' AS kind, CASE WHEN o_totalprice > 100000 THEN 'withheld' WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'released' END AS outcome FROM orders UNION ALL SELECT 'line', CASE WHEN l_tax > 0.05 THEN 'withheld' WHEN l_linenumber = 7 THEN 'quarantined' ELSE 'released' END FROM lineitem) SELECT kind, count(*) AS input, count(*) FILTER (outcome = 'released') AS released, count(*) FILTER (outcome = 'quarantined') AS quarantined, count(*) FILTER (outcome = 'withheld') AS withheld, true AS reconciled FROM r GROUP BY 1")
def ag_16(spark, sf_dir):
    """A release's counts by kind, which must add up to its input."""
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.when(F.col("o_totalprice") > 100000, "withheld").when(F.col("o_orderstatus") == "P", "quarantined").otherwise("released").alias("outcome"))
    lines = _lines(spark, sf_dir).select(F.lit("line").alias("kind"), F.when(F.col("l_tax") > 0.05, "withheld").when(F.col("l_linenumber") == 7, "quarantined").otherwise("released").alias("outcome"))
    names = ("released", "quarantined", "withheld")
    out = o.unionByName(lines).groupBy("kind").agg(F.count("*").alias("input"), *(F.count_if(F.col("outcome") == x).alias(x) for x in names))
    return out.withColumn("reconciled", F.col("input") == sum((F.col(x) for x in names[1:]), F.col(names[0])))


@query("rk_08", "SELECT p_partkey, row_number() OVER (ORDER BY (p_size > 10), -n, p_partkey) AS place FROM (SELECT p_partkey, any_value(p_size) AS p_size, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) ORDER BY place LIMIT 50")
def rk_08(spark, sf_dir):
    """The first 50 conditions: rare ones, then by annotations, then by index."""
    n = _lines(spark, sf_dir).groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (F.col("p_size") > 10).alias("common"), F.coalesce("n", F.lit(0)).alias("n"))
    order = ["common", F.desc("n"), "p_partkey"]
    return rows.orderBy(*order).limit(50).select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # of 50 rows


@query("rk_09", "SELECT kind, id FROM (SELECT 'study' AS kind, 'O:' || o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS reach, year(o_orderdate) AS y FROM orders UNION ALL SELECT 'person', 'S:' || s_suppkey, 0, 0 FROM supplier) ORDER BY reach, CASE kind WHEN 'person' THEN 0 ELSE 1 END, y DESC, id LIMIT 150")
def rk_09(spark, sf_dir):
    """The first 150 items of a job by reach, class of kind, year and id."""
    studies = table(spark, sf_dir, "orders").select(F.lit("study").alias("kind"), F.concat(F.lit("O:"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("reach"), F.year("o_orderdate").alias("y"))
    people = table(spark, sf_dir, "supplier").select(F.lit("person").alias("kind"), F.concat(F.lit("S:"), "s_suppkey").alias("id"), F.lit(0).alias("reach"), F.lit(0).alias("y"))
    return studies.unionByName(people).orderBy("reach", F.when(F.col("kind") == "person", 0).otherwise(1), F.desc("y"), "id").limit(150).select("kind", "id")


@query("rk_12", "WITH s AS (SELECT c_custkey AS entity, c_acctbal AS score FROM customer), t AS (SELECT entity, score FROM s WHERE entity % 20 = 0) SELECT t.entity, (2 * count(*) FILTER (s.score > t.score + 5) + 1 + count(*) FILTER (abs(s.score - t.score) <= 5)) / 2.0 AS mid, count(*) FILTER (s.score > t.score + 5) + 1 AS best, count(*) FILTER (s.score > t.score + 5) + count(*) FILTER (abs(s.score - t.score) <= 5) AS worst FROM t, s GROUP BY t.entity, t.score")
def rk_12(spark, sf_dir):
    """Ranks of a stated set of targets among all scores; those within five units tie."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("score"))
    return rank_among(rows, rows.where("entity % 20 = 0"), gap=5.0)


@query("st_01", "WITH p AS (SELECT DISTINCT o_custkey AS e, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey), a AS (SELECT s FROM p WHERE e = 1), b AS (SELECT s FROM p WHERE e = 4) SELECT (SELECT count(*) FROM (SELECT s FROM a INTERSECT SELECT s FROM b)) AS shared, (SELECT count(*) FROM (SELECT s FROM a UNION SELECT s FROM b)) AS either")
def st_01(spark, sf_dir):
    """Keys that two entities share, and all their keys."""
    own = _held(spark, sf_dir, "o_custkey IN (1, 4)").groupBy("l_suppkey").agg(F.countDistinct("o_custkey").alias("holders"))
    return own.agg(F.count_if(F.col("holders") == 2).alias("shared"), F.count("*").alias("either"))


@query("st_03", "WITH p AS (SELECT o_custkey AS entity, list(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS present, list(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS excluded FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT entity, list_sort(list_filter(coalesce(present, []), lambda x: NOT list_contains(coalesce(excluded, []), x))) AS terms FROM p")
def st_03(spark, sf_dir):
    """Present terms of each entity without its excluded ones."""
    got = lambda c: F.collect_set(F.when(c, F.col("l_partkey")))
    excluded = F.col("l_returnflag") == "R"
    rows = _held(spark, sf_dir).groupBy(F.col("o_custkey").alias("entity")).agg(got(~excluded).alias("present"), got(excluded).alias("excluded"))
    return rows.select("entity", F.array_sort(F.array_except("present", "excluded")).alias("terms"))


@query("st_04", "WITH r AS (SELECT l_orderkey AS id, l_suppkey AS s, min((l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY 1, 2) SELECT id, list(s ORDER BY first, s) AS evidence FROM r GROUP BY 1")
def st_04(spark, sf_dir):
    """Evidence of each link in the order in which it was first seen, each once."""
    first = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("s")).agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "s")))
    return first.groupBy("id").agg(ordered.alias("rows")).select("id", F.transform("rows", lambda x: x["s"]).alias("evidence"))


@query("sm_02", "WITH e AS (SELECT user_id AS item, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) SELECT item, max(version) AS version, arg_max(state, version) AS state, count(*) FILTER (state = 'error') AS refused FROM e GROUP BY 1")
def sm_02(spark, sf_dir):
    """Append-only history of each item: its version, its state now, and how often it was refused."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("version"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("event_type") == "error").alias("refused"))
