"""Text function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.licences import licence_class, licence_class_sql
from ..operators.similarity import simgic
from ..session import table
from .registry import query

WORD = "[^\\p{L}\\p{N}_]+"
NORM = f"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{WORD}', ' ', 'g'))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("fn_01", f"SELECT doc_id, md5({NORM}) AS label FROM documents")
def fn_01(spark, sf_dir):
    """Labels, as digests of the normalised texts."""
    return docs(spark, sf_dir).select("doc_id", F.md5(t.normalize_label(F.col("text")).cast("binary")).alias("label"))


@query("fn_02", f"SELECT doc_id, len(list_filter(string_split({NORM}, ' '), lambda x: x <> ''))::INT AS n_tokens FROM documents")
def fn_02(spark, sf_dir):
    """Tokens of every text."""
    return docs(spark, sf_dir).select("doc_id", F.size(t.tokens(F.col("text"))).alias("n_tokens"))


@query("fn_03", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^0-9a-z]+', ' ', 'g')) AS name FROM part")
def fn_03(spark, sf_dir):
    """ASCII names."""
    return parts(spark, sf_dir).select("p_partkey", t.normalize_name(F.col("p_name")).alias("name"))


@query("fn_04", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^0-9a-z]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def fn_04(spark, sf_dir):
    """Slugs."""
    return parts(spark, sf_dir).select("p_partkey", t.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"))


@query("fn_05", "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: NOT contains(w, '@') AND w <> ''), ' ')) AS kept FROM documents")
def fn_05(spark, sf_dir):
    """Texts without words that hold an e-mail sign."""
    return docs(spark, sf_dir).select("doc_id", F.md5(t.strip_contacts(F.col("text")).cast("binary")).alias("kept"))


@query("fn_06", "SELECT c_custkey, upper('c' || c_nationkey) AS prefix FROM customer")
def fn_06(spark, sf_dir):
    """Prefixes of ids."""
    curie = F.concat(F.lit("c"), "c_nationkey", F.lit(":"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", t.curie_prefix(curie).alias("prefix"))


@query("fn_07", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN round(try_cast(l_quantity AS INT) / nullif(l_linenumber - 4, 0)::DOUBLE, 6) WHEN 1 THEN round(try_cast(l_quantity AS INT) / 100.0::DOUBLE, 6) WHEN 2 THEN 0.545 END AS value FROM lineitem")
def fn_07(spark, sf_dir):
    """Parsed frequencies: cohorts, per cents, terms, and words."""
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    raw = F.when(k == 0, F.concat(q, F.lit("/"), (F.col("l_linenumber") - 4).cast("string"))).when(k == 1, F.concat(q, F.lit("%"))).when(k == 2, "HP:0040282").otherwise("often")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(t.frequency(raw)["value"], 6).alias("value"))


@query("fn_12", f"WITH l AS (SELECT unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]e'))) AS l FROM documents) SELECT {licence_class_sql('l')} AS class, count(*) AS lines FROM l GROUP BY 1")
def fn_12(spark, sf_dir):
    """Licence classes of all lines that name a licence."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("(?i)licen[sc]e"))
    return docs(spark, sf_dir).select(F.explode(lines).alias("l")).groupBy(licence_class(F.col("l")).alias("class")).agg(F.count("*").alias("lines"))


@query("fn_15", "WITH d AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 15, '0') AS s FROM customer), c AS (SELECT c_custkey, (12 - list_reduce(list_prepend(0, list_transform(string_split(s, ''), lambda x: x::INT)), lambda a, x: (a + x) * 2 % 11) % 11) % 11 AS k FROM d) SELECT c_custkey, CASE WHEN k = 10 THEN 'X' ELSE k::VARCHAR END AS check_digit FROM c")
def fn_15(spark, sf_dir):
    """Check characters of personal ids."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 15, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", t.mod_11_2(digits).alias("check_digit"))


@query("fn_16", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www[.]', '') AS host FROM pages")
def fn_16(spark, sf_dir):
    """Hosts of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", t.url_host(F.col("url")).alias("host"))


@query("fn_19", "WITH w AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u FROM w a JOIN w b ON a.id < b.id) SELECT a, b, round(i / u::DOUBLE, 6) AS jaccard FROM p WHERE i > 0 AND 10 * i >= u")
def fn_19(spark, sf_dir):
    """Items whose longer words have a Jaccard of a tenth or more, over all items."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("term"))
    even = w.groupBy("term").agg(F.lit(1.0).alias("ic"))
    return simgic(w, even, 0.1).select("a", "b", F.round("score", 6).alias("jaccard"))


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
CENTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("fn_20", "SELECT l_orderkey, sha256(concat_ws(chr(9), " + ", ".join([*(f"coalesce({c}::VARCHAR, '\\N')" for c in LINE), *(f"coalesce(round({c} * 100)::BIGINT::VARCHAR, '\\N')" for c in CENTS), "coalesce(epoch(l_shipdate)::BIGINT::VARCHAR, '\\N')"]) + ")) AS row_hash FROM lineitem")
def fn_20(spark, sf_dir):
    """Digest of each whole line in tab-separated form; a null is told from an empty field."""
    columns = [*(F.col(c) for c in LINE), *(F.round(F.col(c) * 100).cast("long") for c in CENTS), F.unix_timestamp("l_shipdate")]
    fields = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.sha2(F.concat_ws("\t", *fields).cast("binary"), 256).alias("row_hash"))


WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)"


def words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()


@query("fn_21", f"WITH {WORDS} SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= 1 WHERE damerau_levenshtein(a.w, b.w) <= 1")
def fn_21(spark, sf_dir):
    """All words one edit or swap apart: two such words share a word that a deletion leaves of each."""
    keyed = words(spark, sf_dir).select("w", F.explode(t.deletions(F.col("w"))).alias("key"))
    a, b = (keyed.select("key", F.col("w").alias(c)) for c in ("a", "b"))
    return a.join(b, "key").where("a < b").select("a", "b").distinct().where(t.within_one_edit(F.col("a"), F.col("b")))


@query("fn_22", f"WITH {WORDS} SELECT w, len(list_distinct(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: w[i : i + 2])))::INT AS trigrams FROM w")
def fn_22(spark, sf_dir):
    """Trigrams of every word."""
    return words(spark, sf_dir).select("w", F.size(t.grams(F.col("w"), 3)).alias("trigrams"))


CODES = "translate(w, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000')"


@query("fn_23", f"WITH {WORDS}, c AS (SELECT w, {CODES} AS d FROM w), k AS (SELECT w, list_filter(list_transform(range(2, length(w) + 1), lambda i: CASE WHEN d[i:i] <> '0' AND d[i:i] <> d[i - 1 : i - 1] THEN d[i:i] ELSE '' END), lambda x: x <> '') AS r FROM c) SELECT w, left(w, 1) || array_to_string(r[1:3], '') AS code FROM k")
def fn_23(spark, sf_dir):
    """Sound codes of words."""
    return words(spark, sf_dir).select("w", t.soundex(F.col("w")).alias("code"))


PAGE = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
DECODED = f"replace(replace(replace(replace(replace(replace({PAGE}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("fn_25", f"SELECT page_id, md5(trim(regexp_replace({DECODED}, '\\s+', ' ', 'g'))) AS body FROM pages")
def fn_25(spark, sf_dir):
    """Visible text of pages, as digests."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.html_text(F.col("html")).cast("binary")).alias("body"))


@query("fn_26", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS body FROM documents")
def fn_26(spark, sf_dir):
    """Normalised texts, as digests."""
    return docs(spark, sf_dir).select("doc_id", F.md5(t.document_text(F.col("text")).cast("binary")).alias("body"))


def _redacted() -> tuple[str, str]:
    out, counts = "text", []
    for kind, pattern in t.REDACTIONS:
        quoted = pattern.replace("'", "''")
        counts.append(f"len(regexp_extract_all({out}, '{quoted}')) AS {kind}")
        out = f"regexp_replace({out}, '{quoted}', '[{kind}]', 'g')"
    return out, ", ".join(counts)


@query("fn_27", f"SELECT doc_id, md5({_redacted()[0]}) AS body, {_redacted()[1]} FROM documents")
def fn_27(spark, sf_dir):
    """Every text without personal data, as a digest, and how often each rule met some."""
    found = docs(spark, sf_dir).select("doc_id", t.redact(F.col("text")).alias("r"))
    return found.select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("body"), *(F.col(f"r.{kind}").cast("long").alias(kind) for kind, _ in t.REDACTIONS))


@query("fn_29", "WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) SELECT item_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' '))))::INT AS trigrams FROM w")
def fn_29(spark, sf_dir):
    """Distinct runs of three words."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t.word_ngrams(w, 3)).alias("trigrams"))


@query("fn_30", "SELECT doc_id, instr(lower(text), 'license')::INT AS place, substr(text, greatest(instr(lower(text), 'license') - 20, 1), 47) AS quote FROM documents WHERE lower(text) LIKE '%license%'")
def fn_30(spark, sf_dir):
    """Where a term stands, with a quote around it."""
    place = F.instr(F.lower("text"), "license")
    return docs(spark, sf_dir).where("lower(text) LIKE '%license%'").select("doc_id", place.alias("place"), F.substring(F.col("text"), F.greatest(place - 20, F.lit(1)), F.lit(47)).alias("quote"))


@query("fn_31", "WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations) SELECT a.conv_id, a.turn, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x)))::INT AS unsupported FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def fn_31(spark, sf_dir):
    """Words of a turn that the turn before doesn't hold."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    a, b = w.alias("a"), w.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") - 1))
    return pairs.select("a.conv_id", "a.turn", F.size(F.array_except("a.w", "b.w")).alias("unsupported"))


@query("fn_32", "WITH x AS (SELECT p_partkey, lower(p_type) AS q, lower(p_brand || ' ' || p_type) AS l FROM part) SELECT p_partkey, round(CASE WHEN q = l THEN 1.0 WHEN len(list_filter(string_split(q, ' '), lambda w: NOT list_contains(string_split(l, ' '), w))) = 0 THEN 0.8 WHEN starts_with(l, q) THEN 0.6 ELSE 0.0 END, 6)::DOUBLE AS score FROM x")
def fn_32(spark, sf_dir):
    """Lexical score of a name against a longer one."""
    return parts(spark, sf_dir).select("p_partkey", F.round(t.lexical_score(F.lower("p_type"), F.lower(F.concat_ws(" ", "p_brand", "p_type"))), 6).alias("score"))


@query("fn_34", "SELECT c_custkey, sha256('pepper' || chr(31) || 'person:' || c_name) AS key FROM customer")
def fn_34(spark, sf_dir):
    """Salted keys."""
    return table(spark, sf_dir, "customer").select("c_custkey", t.salted_key("pepper", "person", F.col("c_name")).alias("key"))


@query("fn_35", "SELECT page_id, regexp_matches(url, '^https?://') AND contains(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '.') AS public FROM pages")
def fn_35(spark, sf_dir):
    """Whether an address is public."""
    return table(spark, sf_dir, "pages").select("page_id", t.public_url(F.col("url")).alias("public"))
