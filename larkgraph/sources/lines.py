"""Lines with their numbers in the file, however the file is split; JSON envelopes with a checksum."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GZIP = b"\x1f\x8b"


def _files(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """(path, first two bytes) of every file below ``path``, read by the driver: a listing, and two bytes a file."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    top = hadoop.Path(path)
    fs, out = top.getFileSystem(conf), []
    found = fs.globStatus(top)
    if found is None:
        raise FileNotFoundError(path)
    todo = [s.getPath() for s in found]
    while todo:
        at = todo.pop()
        if at.getName().startswith(("_", ".")):
            continue
        if fs.getFileStatus(at).isDirectory():
            todo += [s.getPath() for s in fs.listStatus(at)]
            continue
        stream = fs.open(at)
        try:
            out.append((at.toString(), bytes(b for b in (stream.read(), stream.read()) if b >= 0)))
        finally:
            stream.close()
    return sorted(out)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line below ``path``, numbered from 1 in its file; only ``\\n`` ends a line, and gz files
    are told by their first two bytes, not by their names.

    Files are split as Spark splits them. Within a split, lines come in order; a row for each split counts them, and the
    counts of the splits before it in the file are added. A gz file is one split. Files whose name belies their
    content are unpacked, or read, whole in one task.
    """
    files = _files(spark, path)
    odd = [f for f, head in files if (head == GZIP) != f.endswith(".gz")]
    plain = [f for f, _ in files if f not in set(odd)]
    out = None
    if plain:
        rows = spark.read.option("lineSep", "\n").text(plain).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.select("file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
        out = rows.join(splits, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")
    if odd:
        whole = spark.read.format("binaryFile").load(odd).select("path", "content").mapInArrow(_unpacked, "file string, line long, value string")
        out = whole if out is None else out.unionByName(whole)
    return out if out is not None else spark.createDataFrame([], "file string, line long, value string")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            stream = gzip.open(io.BytesIO(content)) if content[:2] == GZIP else io.BytesIO(content)
            held: list[str] = []
            n = 0
            for line in stream:
                held.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                if len(held) == 10_000:
                    yield _batch(path, n, held)
                    n, held = n + len(held), []
            yield _batch(path, n, held)


def _batch(path: str, before: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(before + 1, before + 1 + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file", "line", "value"])


def line_sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, id, sha256, value): one JSON record a line; its digest is that of the line as it stands."""
    return numbered(spark, path).select("file", "line", F.get_json_object("value", "$.id").alias("id"), line_sha256(F.col("value")).alias("sha256"), "value")


def tsv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, id, sha256, value): the id is the first field; a ``\\r`` at the end is no part of the line."""
    value = F.regexp_replace("value", "\r$", "")
    rows = numbered(spark, path).withColumn("value", value)
    return rows.select("file", "line", F.substring_index("value", "\t", 1).alias("id"), line_sha256(F.col("value")).alias("sha256"), "value")


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, letters as they are, and the shortest spelling of a float that reads back the same."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


RECORDS = "file string, schema string, version long, verified boolean, index long, id string, sha256 string, record string"


def envelopes(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...], verify: bool = True) -> DataFrame:
    """Records of JSON files {schema, version, header, records}: file, schema, version, verified, index, id, sha256, record.

    An unknown schema or version raises; so does, with ``verify``, a digest of all records that is not the header's. Otherwise
    ``verified`` tells. ``record`` is canonical JSON and ``sha256`` its digest. A file is one JSON value and read in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                body = json.loads(text)
                found, version = body.get("schema") or "", body.get("version") or 0
                if (schema and found != schema) or version not in versions:
                    raise ValueError(f"{file}: schema {found} version {version}, expected {schema} {versions}")
                records = body.get("records") or []
                header = body.get("header") or {}
                verified = hashlib.sha256(canonical(records).encode()).hexdigest() == header.get("sha256", "")
                if verify and not verified:
                    raise ValueError(f"{file}: the records don't have the header's checksum")
                rows = [canonical(r) for r in records]
                n = len(rows)
                ids = [r.get("id") if isinstance(r, dict) and isinstance(r.get("id"), str) else None for r in records]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array([found] * n, pa.string()), pa.array([version] * n, pa.int64()), pa.array([verified] * n, pa.bool_()), pa.array(range(n), pa.int64()), pa.array(ids, pa.string()), pa.array([hashlib.sha256(r.encode()).hexdigest() for r in rows], pa.string()), pa.array(rows, pa.string())],
                    ["file", "schema", "version", "verified", "index", "id", "sha256", "record"],
                )

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInArrow(run, RECORDS)
