"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, which all executors share, and read back."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkgraph-"))  # tests and single machines
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        pass


_folders: dict[str, str] = {}


def written(df: DataFrame, *partition: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder, read back; it is removed when the driver ends. ``partition``: columns with a folder for each value.

    For loops of many rounds: a checkpoint hands on its plan's estimate of size, which joins multiply round by round
    until planning takes longer than the work, whereas a table has the size of its files.
    """
    spark: SparkSession = df.sparkSession
    root, app = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.applicationId
    if app not in _folders:
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="larkgraph-")  # tests and single machines
        _folders[app] = f"{root.rstrip('/')}/rounds-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    to = f"{_folders[app]}/{uuid.uuid4().hex}"
    df.write.parquet(to, partitionBy=list(partition) or None)
    return spark.read.schema(df.schema).parquet(to).select(df.columns)


#: Rows of a task, about, where the session's partitions would hold more.
ROWS = 1 << 19


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys``, so that tasks stay as large as they are however many rows there are.

    Left alone while the session's number of partitions is enough for that.
    """
    parts = -(-rows // ROWS)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast, unless it has few ``rows``.

    Spark goes by the size in files or in a shuffle; names that differ in few letters are ten to thirty times as large in
    the driver's memory, so that a table of 10 MB takes hundreds there.
    """
    return df if rows is not None and rows <= FEW else df.hint("merge")


#: Rows that may be broadcast.
FEW = 1 << 16


def running(df: DataFrame, order: Column, parts: int = 0, **sums: Column) -> DataFrame:
    """``df`` with running sums in an order over the whole table, in range partitions; no task sees all rows.

    ``order`` has no ties. Each of ``sums`` is summed within its range, to which the sums of the ranges before are
    added; only one row for each range is summed in one place.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(totals), "_part")  # one row a range
    return out.withColumns({k: F.sum(f"_v_{k}").over(own) + F.col(f"_b_{k}") for k in sums}).drop("_part", *(f"_{x}_{k}" for k in sums for x in "vb"))


#: First letters of digests by which they are grouped, level by level.
WIDTHS = (8, 4, 0)


def fingerprint(digests: DataFrame) -> DataFrame:
    """One row, ``fingerprint``, of a table of digests ``h`` (hex), whatever their order; none for an empty table.

    Digests are sorted and hashed in groups by their first letters, then the groups' digests, with fewer letters, until
    there is one. So a group holds some hundreds of rows where there are 10^12, and later levels 65,536 at most.
    Digests go through the shuffles as bytes, half as long as their letters.
    """
    level = digests.select("h")
    for width in WIDTHS:
        body = F.sha2(F.array_join(F.array_sort(F.transform(F.collect_list(F.unhex("h")), lambda x: F.lower(F.hex(x)))), "").cast("binary"), 256)
        level = level.groupBy(F.substring("h", 1, width).alias("k")).agg(body.alias("body")).select(F.concat("k", "body").alias("h"))
    return level.withColumnRenamed("h", "fingerprint")
