"""Secret scans over an incremental ledger of blobs.

Every version of a file is a row with a path, an id and its text. A blob is a distinct text, addressed by
its SHA-256. The ledger holds the (blob, rule version) pairs that were scanned and their findings; a run
scans only the pairs that are not in it, appends them, and joins the findings back to all rows that hold
the blob, old ones included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, documents


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of ``pattern`` that don't overlap, kept if ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: bytes
    group: int
    least: int


#: The base kinds first, in their order; then kinds that this scan adds.
RULES = (
    Rule("assign", 1, rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, rb"[0-9a-f]+", 0, 16),
    Rule("pem", 1, rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
    Rule("jwt", 1, rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", 1, rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", 1, rb"xox[abpr]-[A-Za-z0-9-]+", 0, 24),
)
BASE = ("assign", "access", "hex")
#: A run of hex digits shorter than its least length can't match, so the search may skip it.
_FAST = {"hex": rb"[0-9a-f]{16,}", "access": rb"AKIA[A-Z0-9]{14,}"}

SPAN = "struct<rule:string,start:long,end:long>"
SCHEMA = f"blob binary, rules array<string>, spans array<{SPAN}>"


def version(rule: Rule) -> str:
    """A rule's identity in the ledger: kind, version and a digest of its pattern and limits."""
    digest = hashlib.sha256(b"%s\0%d\0%d" % (rule.pattern, rule.group, rule.least)).hexdigest()
    return f"{rule.kind}@{rule.version}:{digest[:12]}"


def scan_text(data: bytes, rules=RULES) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, place of the kind) in code points, by start and then kind as listed."""
    found = []
    for place, rule in enumerate(rules):
        fast = _FAST.get(rule.kind) if rule in RULES else None
        for m in re.finditer(fast or rule.pattern, data):
            if len(m.group(rule.group)) >= rule.least:  # the groups that count are ASCII
                found.append((m.start(), m.end(), rule.kind, place))
    found.sort(key=lambda x: (x[0], x[3], x[1]))
    if found and not data.isascii():
        cuts = sorted({p for x in found for p in x[:2]})
        points, last, n = {}, 0, 0
        for p in cuts:
            n += len(data[last:p].decode("utf-8", "replace"))
            points[p], last = n, p
        found = [(points[a], points[b], kind, place) for a, b, kind, place in found]
    return found


def with_blobs(versions: DataFrame) -> DataFrame:
    """``blob``: the SHA-256 of the text as 32 bytes; a null text is an empty one."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, pending): each whole text is scanned by its pending rules."""
    by_version = {version(r): r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, pending = batch.column("text"), batch.column("pending")
            spans = []
            for text, names in zip(texts, pending):
                todo = [by_version[x] for x in names.as_py()]
                name = {r.kind: version(r) for r in todo}
                spans.append([{"rule": name[k], "start": a, "end": b} for a, b, k, _ in scan_text(text.as_py() or b"", todo)])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pending, pa.array(spans, span)], ["blob", "rules", "spans"])

    return blobs.select("blob", F.col("text").cast("binary").alias("text"), "pending").mapInArrow(run, SCHEMA)


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, as Parquet below a shared folder.

    A pair that was scanned without a finding is in it too. A run appends one committed write, so a run
    that is lost halfway leaves no scanned pair without its findings; scanning a pair twice changes nothing.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """One row for each blob: the rule versions that scanned it and all their spans."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        both = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("rules", "spans")]
        return rows.groupBy("blob").agg(*both)

    def update(self, versions: DataFrame, rules=RULES) -> None:
        """Scans the pairs of ``versions`` (doc_id, text) and ``rules`` that the ledger lacks, and appends them."""
        addressed = with_blobs(versions.select("doc_id", "text").where("text <> ''"))  # nothing is in an empty blob
        first = addressed.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        wanted = F.array(*(F.lit(version(r)) for r in rules))
        if self._exists():
            known = self.read().select("blob", "rules")
            first = first.join(known, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>"))))
        else:
            first = first.withColumn("pending", wanted)
        todo = first.where(F.size("pending") > 0).select("blob", F.col("doc_id").alias("first_id"), "pending")
        own = addressed.withColumnRenamed("blob", "own_blob")
        texts = own.join(todo, (F.col("own_blob") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("blob", "text", "pending")
        scan_blobs(texts, rules).write.mode("append").parquet(self.path)


def findings(versions: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """doc_id, blob and spans (kind, start, end; by start, then kind as listed) of every row of ``versions``.

    Null texts are empty and have no spans; rows that share a text share its findings; a repeated row is
    reported again; an empty table gives none.
    """
    ledger.update(versions, rules)
    kind = F.create_map(*(F.lit(x) for r in rules for x in (version(r), r.kind)))
    place = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (version(r), i)))
    own = F.filter("spans", lambda x: x["rule"].isin([version(r) for r in rules]))
    ordered = F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.element_at(place, x["rule"]).alias("place"), x["end"].alias("end"), F.element_at(kind, x["rule"]).alias("kind"))))
    # Only blobs with findings are joined; written, so that the rows of a blob of many copies can be split.
    found = Scratch(versions.sparkSession, "op9-found").write(ledger.read().where(F.size("spans") > 0).select(F.col("blob").alias("found"), ordered.alias("spans")), "found")
    blank = F.coalesce(F.col("text"), F.lit("")) == ""
    key = F.when(blank, F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))  # empty texts meet nothing, anywhere
    rows = with_blobs(versions.select("doc_id", "text").withColumn("key", key)).select("doc_id", "blob", F.coalesce("key", "blob").alias("key"))
    empty = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    return rows.join(found, F.col("key") == F.col("found"), "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Session setting that names the folder of a ledger that outlives a run.
LEDGER = "spark.larkgraph.secrets.ledger"


def op9_secrets(spark, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Counts and digest of the base kinds' spans, and all spans, for every document.

    With a ``ledger`` folder, given here or by the session's ``LEDGER``, only pairs that it lacks are scanned
    and the rest comes from it; without one the run starts a ledger of its own.
    """
    where = ledger or spark.conf.get(LEDGER, None) or f"{Scratch(spark, 'op9').path}/ledger"
    found = findings(documents(spark, sf_dir), Ledger(spark, where))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return found.select("doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
