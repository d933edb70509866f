"""Tables in hash buckets of their key, of which a load rewrites only those it touches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rows


#: Of applications without a shared folder, on one machine: the temporary one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors are one machine, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        # the setting itself can't be changed in a session
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="remarkt-")
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_dir(spark)}/remarkt-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


class BucketTable:
    """A table of unique keys in hash buckets; rows without a key are in the bucket of null.

    Every load writes the buckets it touches anew, in a folder of its own, and then a manifest that names the folder
    of each bucket. Readers follow the last manifest that was written whole: a load that dies leaves the table as it
    was, and run again it starts over. A load that a manifest lists already changes nothing. Of two loads at once one
    fails, since both would write the same manifest.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast("string")), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[str]:
        """Manifests that were written whole, in order."""
        return [v for v in names(self.spark, f"{self.path}/manifest") if exists(self.spark, f"{self.path}/manifest/{v}/_SUCCESS")]

    def manifest(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{versions[-1]}").first()[0])

    def _rows(self, manifest: dict, only: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{load}/_bucket={b}" for b, load in sorted(manifest["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        found = self.manifest()
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(found)

    def create(self, df: DataFrame, load: str = "first") -> None:
        if self.manifest() is not None:
            raise ValueError(f"a table is at {self.path}")
        self._commit(None, df, load, range(self.buckets))

    def merge(self, new: DataFrame, load: str, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of new's keys by apply(their rows, new); the buckets that were written.

        new is read twice. apply gives rows of the same buckets alone, with the table's columns.
        """
        held = self.manifest()
        if held is None:
            raise ValueError(f"no table at {self.path}")
        if load in held["loads"]:
            return []
        # as many rows as there are buckets at most
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())
        self._commit(held, apply(self._rows(held, touched), new), load, touched)
        return touched

    def upsert(self, new: DataFrame, load: str, update: Sequence[str]) -> list[int]:
        return self.merge(new, load, lambda old, n: rows.upsert(old, n, self.key, update))

    def insert_absent(self, new: DataFrame, load: str, order: Sequence[Column | str]) -> list[int]:
        return self.merge(new, load, lambda old, n: rows.insert_absent(old, n, self.key, order))

    def _commit(self, held: dict | None, df: DataFrame, load: str, touched: Sequence[int]) -> None:
        if load in (held["loads"] if held else []) or not load or set("/=\\ ") & set(load):
            raise ValueError(f"not a new load's name: {load!r}")
        data = f"{self.path}/data/{load}"
        # what an earlier try of this load left is replaced
        placed = df.withColumn("_bucket", self.bucket())
        placed.repartition(F.col("_bucket")).sortWithinPartitions(f"`{self.key}`").write.mode("overwrite").partitionBy("_bucket").parquet(data)
        written = set(names(self.spark, data))
        buckets = {b: x for b, x in (held["buckets"] if held else {}).items() if int(b) not in set(touched)}
        buckets |= {str(b): load for b in touched if f"_bucket={b}" in written}
        manifest = {"loads": [*(held["loads"] if held else []), load], "schema": json.loads(df.schema.json()), "buckets": buckets}
        version = f"v{len(manifest['loads']):08d}"
        if version not in self._versions():
            # of one that wasn't written whole
            delete(self.spark, f"{self.path}/manifest/{version}")
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{version}")

    def vacuum(self) -> None:
        """Delete what the last manifest doesn't name; earlier readers must be done."""
        held = self.manifest() or {"buckets": {}}
        kept = {(load, f"_bucket={b}") for b, load in held["buckets"].items()}
        for load in names(self.spark, f"{self.path}/data"):
            for bucket in names(self.spark, f"{self.path}/data/{load}"):
                if bucket.startswith("_bucket=") and (load, bucket) not in kept:
                    delete(self.spark, f"{self.path}/data/{load}/{bucket}")


def write_layout(df: DataFrame, table: str, key: str, buckets: int, path: str, blooms: Sequence[str] = (), values: int = 1_000_000) -> DataFrame:
    """A catalogue table bucketed and sorted by key, with Parquet bloom filters on some columns: joins on the key then shuffle at most the other side, and look-ups skip row groups."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path)
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(values))
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
