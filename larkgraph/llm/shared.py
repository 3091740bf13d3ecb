"""What the operators of this subpackage share: word expressions and written intermediate tables.

Intermediate results that are read more than once are written as Parquet below the shared folder that
the session names in ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and \t \n \v \f \r.
SPACE = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]+"


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch. Spark's own 10,000 texts are tens of MB at a time, in the JVM of the executor and in each Python worker.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks hand Python ``BATCH_ROWS`` rows at a time; a number that the session has set holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


class Scratch:
    """A folder of written tables for one run of an operator; removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="larkgraph-")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def write(self, df: DataFrame, name: str, *partition: str) -> DataFrame:
        """Writes ``df`` and returns the table read back."""
        to = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(to, partitionBy=list(partition) or None)
        return self.spark.read.schema(df.schema).parquet(to)

    def remove(self, name: str = "") -> None:
        """Removes one table, or all of them."""
        try:
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before
            if name:
                raise

    def release(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of finished steps now, not at some later collection."""
        gc.collect()  # plans that Python still names keep their shuffles
        self.spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
