"""A keyed table that streams keep: hash buckets, and a manifest per version.

Version k says of every bucket which version wrote its files. A new version writes the
buckets that its rows fall in and takes the others over by name, so a batch costs
as much as the buckets it touches. The folder is the state: a new object finds the
complete versions, and a batch that runs again writes its version again, from the
newest complete one below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage

BUCKETS = 64


class BucketTable:
    """Rows with unique ``keys`` (or rows that are replaced together per key) below ``path``, dealt by ``deal``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], deal: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.keys, self.deal = list(keys), list(deal or keys)

    def _found(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return [f.getPath().toString() for f in found or []]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.deal), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending."""
        return sorted(int(x.split("/")[-2][1:]) for x in self._found("manifest/v*/_SUCCESS"))

    def manifest(self, version: int) -> dict[int, int]:
        """The version that wrote each bucket of a version."""
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest/v{version}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def before(self, version: int) -> dict[int, int]:
        """Manifest of the version that this one builds on."""
        older = [v for v in self.versions() if v < version]
        return self.manifest(older[-1]) if older else {}

    def _read(self, manifest: dict[int, int], only: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(manifest.items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """A version, by default the newest complete one."""
        versions = self.versions() if version is None else [version]
        return self._read(self.manifest(versions[-1]) if versions else {})

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that hold the given values of ``deal``: a number each."""
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def rows_of(self, keys: DataFrame, version: int, whole: bool = False) -> DataFrame:
        """Rows with the given values of ``deal``, as version ``version`` finds them; reads their buckets only.

        ``whole`` returns all rows of these buckets.
        """
        held = self._read(self.before(version), self.touched(keys))
        return held if whole else held.join(keys.select(*self.deal).distinct(), _same(held, keys, self.deal), "left_semi")

    def upsert(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """Write a version in which the rows replace those with the same keys; rows with the keys ``gone`` go."""
        fresh = cut_lineage(rows.select(self.schema.names), "changes")
        keys = fresh.select(*self.keys).distinct()
        if gone is not None:
            keys = cut_lineage(keys.union(gone.select(*self.keys)).distinct(), "keys")
        older, touched = self.before(version), self.touched(keys)
        held = self._read(older, touched)
        kept = held.join(keys, _same(held, keys, self.keys), "left_anti")
        target = f"{self.path}/data/v{version}"
        both = kept.unionByName(fresh).withColumn("bucket", self._bucket())
        both.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(target)
        written = {int(x.rpartition("=")[2]): version for x in self._found(f"data/v{version}/bucket=*")}
        now = {b: v for b, v in older.items() if b not in set(touched)} | written
        listed = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")

    def bytes_written(self, version: int) -> int:
        """Size of the files that a version wrote itself."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/v{version}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(at).getLength() if files.exists(at) else 0

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete what only versions before the newest ``keep`` need; returns the versions whose files went."""
        versions = self.versions()
        needed = {v for k in versions[-keep:] for v in self.manifest(k).values()}
        written = sorted(int(x.rpartition("/v")[2]) for x in self._found("data/v*"))
        old = [v for v in written if v not in needed and versions and v <= versions[-1]]
        for folder, gone in (("manifest", versions[:-keep]), ("data", old)):
            for v in gone:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/v{v}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return old


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same &= a[k].eqNullSafe(b[k])
    return same
