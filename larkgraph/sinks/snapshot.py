"""Snapshots of derived tables, rebuilt only when what they come from has changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def signature(spark: SparkSession, inputs: list[str], version: str = "") -> str:
    """A digest of names, sizes and times of all files below ``inputs``, and of the ``version`` of what is built from them.

    It is worked out from a listing, without a job. An input that isn't there counts as such.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(inputs):
        top = hadoop.Path(name)
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            seen.append((name, -1, -1))
            continue
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([version, sorted(seen)]).encode()).hexdigest()


class Snapshots:
    """Tables below ``root``. A commit is one small file, named by its number, that appears whole or not at all.

    Tables are written to a folder of their own first, so a job that fails leaves the last commit as it was, and readers
    of an older one can go on.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _last(self) -> int:
        if not self._fs.exists(self._path("commits")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("commits"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def current(self) -> dict | None:
        """The last commit: signature, folder, tables."""
        n = self._last()
        if not n:
            return None
        stream = self._fs.open(self._path("commits", f"{n}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def save(self, tables: dict[str, DataFrame], signed: str) -> None:
        folder = f"{signed[:16]}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        body = {"signature": signed, "folder": folder, "tables": {name: df.schema.json() for name, df in tables.items()}}
        draft = self._path(f".{folder}.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps(body).encode())
        finally:
            stream.close()
        self._fs.mkdirs(self._path("commits"))
        target = self._path("commits", f"{self._last() + 1}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"{target}: another writer was first")

    def load(self) -> dict[str, DataFrame]:
        from pyspark.sql.types import StructType

        at = self.current()
        if at is None:
            raise FileNotFoundError(f"{self.root}: no snapshot")
        return {name: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{at['folder']}/{name}") for name, schema in at["tables"].items()}

    def fresh(self, inputs: list[str], build: Callable[[], dict[str, DataFrame]], version: str = "") -> dict[str, DataFrame]:
        """The tables of the last commit if ``inputs`` are as they were then; else they are built, committed and read."""
        signed, at = signature(self.spark, inputs, version), self.current()
        if at is None or at["signature"] != signed:
            self.save(build(), signed)
        return self.load()
