"""Tables with one row a key that take small updates without being rewritten.

Rows are dealt by a hash of the key into a fixed number of buckets; a bucket's rows lie in a folder of the version that wrote them.
A manifest for each version names the folder of every bucket.  An update rewrites the buckets whose keys it has and takes over the
other folders as they are; the new version counts once its manifest is renamed into place.  Readers go by the newest manifest.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumbre.sources.folders import file_system


class KeyedTable:
    """``merge`` makes one row of the stored and new rows of a key: columns by aggregate.

    ``buckets`` is fixed when the table is made; a bucket should fit a task comfortably when the table is as large as expected.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, merge: dict[str, Callable[[str], Column]], buckets: int = 64):
        self.spark, self.path, self.key, self.merge, self.buckets = spark, path, key, merge, buckets

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def versions(self) -> list[int]:
        fs, root = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(root):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(root) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        found = [v for v in self.versions() if version is None or v == version]
        if not found:
            return None
        fs, at = file_system(self.spark, f"{self.path}/manifests/{found[-1]:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first update."""
        manifest = manifest or self.manifest()
        if manifest is None:
            return None
        held = {int(b): folder for b, folder in manifest["folders"].items()}
        paths = [f"{self.path}/{folder}" for b, folder in held.items() if only is None or b in only]
        rows = self.spark.read.schema(manifest["schema"])
        return rows.parquet(*paths) if paths else self.spark.createDataFrame([], manifest["schema"])

    def update(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Merge ``rows`` in; returns the buckets that were rewritten.  A batch number that was applied before changes nothing."""
        old = self.manifest()
        if old and batch is not None and old["batch"] is not None and old["batch"] >= batch:
            return []
        n = old["buckets"] if old else self.buckets
        version = (self.versions() or [0])[-1] + 1
        fresh = rows.groupBy(self.key).agg(*[f(c).alias(c) for c, f in self.merge.items()])
        # what the update says by key is written aside: it is read once to see the buckets and once to merge
        aside = f"{self.path}/updates/{version:012d}"
        fresh.withColumn("_bucket", self._bucket(n)).write.mode("overwrite").parquet(aside)
        fresh = self.spark.read.parquet(aside)
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most the number of buckets
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.drop("_bucket").schema)
        if touched:
            both = fresh
            if old:
                both = both.unionByName(self.read(touched, old).withColumn("_bucket", self._bucket(n)))
            merged = both.repartition("_bucket").groupBy("_bucket", self.key).agg(*[f(c).alias(c) for c, f in self.merge.items()])
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/version={version:012d}")
        folders = dict(old["folders"]) if old else {}
        folders |= {str(b): f"data/version={version:012d}/_bucket={b}" for b in touched}
        self._commit(version, {"batch": batch if batch is not None else (old or {}).get("batch"), "buckets": n, "schema": schema, "folders": folders})
        self._clean(version)
        return touched

    def _commit(self, version: int, manifest: dict) -> None:
        fs, aside = file_system(self.spark, f"{self.path}/manifests/_{version:012d}.tmp")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(aside, file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")[1]):
            raise RuntimeError(f"version {version} of {self.path} was written by somebody else")

    def _clean(self, version: int) -> None:
        """Drop what neither this version nor the one before it names, so readers of that one can finish."""
        fs, root = file_system(self.spark, self.path)
        fs.delete(file_system(self.spark, f"{self.path}/updates/{version:012d}")[1], True)
        kept = [v for v in self.versions() if v >= version - 1]
        named = {folder for v in kept for folder in self.manifest(v)["folders"].values()}
        for v in self.versions():
            if v not in kept:
                fs.delete(file_system(self.spark, f"{self.path}/manifests/{v:012d}.json")[1], True)
        data = file_system(self.spark, f"{self.path}/data")[1]
        if not fs.exists(data):
            return
        for s in fs.listStatus(data):
            name = s.getPath().getName()
            parts = [p.getPath().getName() for p in fs.listStatus(s.getPath()) if p.getPath().getName().startswith("_bucket=")]
            for part in parts:
                if f"data/{name}/{part}" not in named:
                    fs.delete(file_system(self.spark, f"{self.path}/data/{name}/{part}")[1], True)


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, version: str, buckets: int = 64) -> list[int]:
    """Merge rows by key, the newer version wins; returns the buckets that were rewritten."""
    rows = updates.select(key, F.struct(F.col(version).alias("version"), F.struct(*[F.col(f"`{c}`") for c in updates.columns]).alias("row")).alias("_row"))
    return KeyedTable(spark, path, key, {"_row": lambda c: F.max_by(c, F.col("_row.version"))}, buckets).update(rows)


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the table, None before the first update."""
    df = KeyedTable(spark, path, "", {}).read()
    return df.select("_row.row.*") if df is not None and "_row" in df.columns else df
