"""Decisions about identity links that can be taken back: assertions stay as they came, decisions are appended and replayed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import ineligible, prefix
from .graph import components
from .stored import fingerprint

#: Predicates that state identity, those that tell two things apart, and prefixes of mere aliases.
IDENTITY = ("skos:exactMatch", "owl:sameAs", "owl:equivalentClass")
APART = ("skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch", "RO:0002205", "RO:HOM0000017")
ALIASES = ("ICTRP", "pubmed.author", "epmc.author")
#: What an assertion consists of; its id is a digest of all of it.
ASSERTION = ("file", "line", "subject", "predicate", "object", "justification", "conflict", "rule", "rule_version", "evidence_url", "evidence_locator", "evidence_sha256")
REVIEW = "input_digest string, actor string, reviewed_at string, reason string, assertion string, revoked boolean"


def identified(assertions: DataFrame) -> DataFrame:
    """``assertions`` with ``assertion``, a digest of the row; a null is told from an empty value."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in ASSERTION]
    return assertions.select(*ASSERTION).withColumn("assertion", F.sha2(F.concat_ws("|", *parts), 256))


def input_digest(rows: DataFrame) -> str:
    """One digest of all assertions, whatever their order."""
    found = fingerprint(rows.select(F.col("assertion").alias("h"))).first()
    return found[0] if found else ""


class Reviews:
    """An append-only table of reviews below ``path``; a review is about one input and can revoke or restore assertions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, reviews: DataFrame) -> None:
        """Adds reviews; each needs an actor, a time and a reason."""
        lacking = F.lit(False)
        for c in ("input_digest", "actor", "reviewed_at", "reason", "assertion"):
            lacking = lacking | F.col(c).isNull() | (F.trim(c) == "")
        if reviews.where(lacking).limit(1).count():
            raise ValueError("a review needs an input, an actor, a time, a reason and an assertion")
        reviews.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in REVIEW.split(", "))).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], REVIEW)
        return self.spark.read.schema(REVIEW).parquet(self.path)


@dataclass(frozen=True)
class Policy:
    """Which versions of which rules may state identity, by which predicates: (rule, version, predicate)."""

    rules: tuple[tuple[str, str, str], ...]


def decide(rows: DataFrame, policy: Policy, reviews: DataFrame, digest: str) -> DataFrame:
    """``rows`` (identified assertions) with ``status`` and ``reason``, by their first reason on the ladder.

    Links that state identity are rejected if they are ineligible, come from a rule or version that the policy does not know,
    lack a receipt of their evidence, or were revoked by a review; the last review of an assertion counts, and only
    reviews of this very input. The links that are left make components; all links of a component that holds two ids
    of a prefix (but of mere aliases), or two ids that a typed relation tells apart, are quarantined with it.
    Other predicates are ``typed_or_candidate``. Nothing is dropped and ``rows`` stay as they are, so the same
    input and reviews always give the same decisions.
    """
    states = F.col("predicate").isin(*IDENTITY)
    known = F.lit(False)
    for rule, version, predicate in policy.rules:
        known = known | ((F.col("rule") == rule) & (F.col("rule_version") == version) & (F.col("predicate") == predicate))
    receipt = (F.coalesce("evidence_url", F.lit("")) != "") & (F.coalesce("evidence_locator", F.lit("")) != "") & F.coalesce(F.col("evidence_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    last = reviews.where(F.col("input_digest") == digest).groupBy("assertion").agg(F.max_by("revoked", F.struct("reviewed_at", "revoked")).alias("_revoked"))
    # Digests meet as bytes, half as long as their letters; what is no digest meets nothing.
    last = last.where(F.col("assertion").rlike("^[0-9a-f]{64}$")).select(F.unhex("assertion").alias("_key"), "_revoked")
    own = F.coalesce(F.col("rule"), F.lit(""))
    ladder = F.coalesce(
        ineligible(F.col("subject"), F.col("object"), F.coalesce("justification", F.lit("")), F.coalesce("conflict", F.lit("")), own),
        F.when(~F.coalesce(known, F.lit(False)), "unknown_rule_or_version"),
        F.when(~receipt, "missing_evidence_receipt"),
    )
    # The ladder stands before the join, which then carries its reason and not all that it reads.
    first = rows.withColumn("_why", F.when(states, ladder)).withColumn("_key", F.unhex("assertion")).join(last, "_key", "left")
    first = first.withColumn("_reason", F.when(states & F.col("_revoked"), "review_revoked").otherwise(F.col("_why"))).drop("_revoked", "_why", "_key")
    links = first.where(states & F.col("_reason").isNull()).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    named = components(links)
    kinds = named.groupBy("component", prefix(F.col("node")).alias("p")).agg(F.count("*").alias("n")).where((F.col("n") > 1) & ~F.col("p").isin(*ALIASES))
    collides = kinds.groupBy("component").agg(F.concat(F.lit("component_prefix_collision:"), F.array_join(F.array_sort(F.collect_set("p")), ",")).alias("_bad"), F.lit(1).alias("_order"))
    typed = rows.where(F.col("predicate").isin(*APART)).select(F.col("subject").alias("a"), F.col("object").alias("b")).distinct()
    x, y = (named.select(F.col("node").alias(c), F.col("component").alias(k)) for c, k in (("a", "component"), ("b", "_other")))
    collapses = typed.join(x, "a").join(y, "b").where("component = _other").select("component").distinct().select("component", F.lit("component_collapses_typed_relation").alias("_bad"), F.lit(0).alias("_order"))
    bad = collides.unionByName(collapses).groupBy("component").agg(F.min_by("_bad", "_order").alias("_bad"))
    bad = named.join(bad, "component").select(F.col("node").alias("subject"), "_bad")
    out = first.join(bad, "subject", "left")
    reason = F.when(states, F.coalesce("_reason", "_bad"))
    status = F.when(~states, "typed_or_candidate").when(reason.isNotNull(), "rejected").otherwise("accepted")
    return out.select("assertion", *ASSERTION, status.alias("status"), reason.alias("reason"))


def accepted(decisions: DataFrame) -> DataFrame:
    """(node, representative): what the accepted links make one; rebuilt from decisions, so a revoked link leaves no trace."""
    links = decisions.where("status = 'accepted'").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return components(links).select("node", F.col("component").alias("representative"))
