"""A table in buckets of its key, of which a merge rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketedTable:
    """Rows of one key lie in one bucket; every version of a bucket is a folder of its own.

    ``versions/version=v/bucket=b`` has the rows of bucket b as merge v wrote them, ``manifests/version=v``
    the version of each bucket that holds after merge v, in a single file, so that a reader sees all of
    a merge or nothing. Merge v reads the table as manifest v - 1 has it and writes no folder that this
    manifest names: run again after a failure it gives the same table, whatever the merge function does.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):  # noqa: ANN202
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        """Merges that are complete."""
        fs, target = self._fs(f"{self.path}/manifests")
        if not fs.exists(target):
            return []
        done = (s.getPath() for s in fs.listStatus(target) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return sorted(int(p.getName().removeprefix("version=")) for p in done)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Version by bucket, as of the last merge or that of ``version``; a number for each bucket."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        return {r["bucket"]: r["of"] for r in self.spark.read.schema("bucket int, of bigint").parquet(f"{self.path}/manifests/version={known[-1]}").collect()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table, or the buckets ``only``."""
        folders = [f"{self.path}/versions/version={v}/bucket={b}" for b, v in sorted(self.manifest(version).items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Write ``combine(stored, batch)`` for the buckets of ``batch``, whose numbers are returned.

        ``combine`` works key by key: it gives rows of the keys that it gets, and those of a key depend on no other.
        """
        batch = batch.persist()
        try:
            touched = {r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()}  # ``buckets`` numbers at most
            before = self.manifest(version - 1)
            merged = combine(self.read(version - 1, touched), batch).select(*self.schema.names).withColumn("bucket", self.bucket())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/versions/version={version}")
        finally:
            batch.unpersist()
        fs, target = self._fs(f"{self.path}/versions/version={version}")
        full = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(target) if s.getPath().getName().startswith("bucket=")}
        after = {b: v for b, v in before.items() if b not in touched} | {b: version for b in full}
        rows = self.spark.createDataFrame(sorted(after.items()), "bucket int, of bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Delete buckets and manifests that none of the last ``keep`` merges names; how many folders went."""
        known = self.versions()
        named = {(b, v) for k in known[-keep:] for b, v in self.manifest(k).items()}
        gone = 0
        for v in known:
            fs, target = self._fs(f"{self.path}/versions/version={v}")
            for s in fs.listStatus(target) if fs.exists(target) else []:
                name = s.getPath().getName()
                if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), v) not in named:
                    gone += bool(fs.delete(s.getPath(), True))
        for v in known[:-keep]:
            fs, target = self._fs(f"{self.path}/manifests/version={v}")
            fs.delete(target, True)
        return gone
