"""Snapshots with optimistic commits: every revision is its own Parquet folder, and a pointer that can be created only once names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RevisionConflict(RuntimeError):
    """Someone else committed the revision first."""


class SnapshotStore:
    """Revisions of a table under `root`, on any file system that Spark can reach.

    A commit writes the rows to a folder of its own and then creates the pointer `_rev/<n>` without overwriting; only one writer can
    create it, so a lost race raises `RevisionConflict` and the other rows stay unseen. Readers see whole revisions only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def revision(self) -> int:
        """The latest revision; 0 if nothing was committed."""
        folder = self._path(f"{self.root}/_rev")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def load(self, revision: int | None = None) -> DataFrame:
        revision = self.revision() if revision is None else revision
        if not revision:
            raise FileNotFoundError(f"no revision in {self.root}")
        folder = self.spark.read.text(f"{self.root}/_rev/{revision}").first()[0]
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def commit(self, rows: DataFrame, expected: int) -> int:
        """Writes `rows` as revision `expected` + 1, if `expected` is still the latest."""
        if self.revision() != expected:
            raise RevisionConflict(f"expected revision {expected}, found {self.revision()}")
        folder = f"data-{expected + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        self._fs.mkdirs(self._path(f"{self.root}/_rev"))
        try:
            out = self._fs.create(self._path(f"{self.root}/_rev/{expected + 1}"), False)
        except Exception as e:
            raise RevisionConflict(f"revision {expected + 1} was committed meanwhile") from e
        out.write(bytearray(folder.encode()))
        out.close()
        return expected + 1

    def append_new(self, rows: DataFrame, key: str, expected: int) -> int:
        """Appends those of `rows` whose key no stored row has; repeats within `rows` count once."""
        fresh = rows.dropDuplicates([key])
        if expected:
            stored = self.load(expected)
            fresh = stored.unionByName(fresh.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)
        return self.commit(fresh, expected)

    def manifest(self, revision: int | None = None) -> DataFrame:
        """(rows, checksum) of a revision, independent of the order of its rows."""
        df = self.load(revision)
        return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))
