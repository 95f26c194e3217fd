"""A table of the newest value of each key, for streams in update mode.

Rows lie in buckets by a hash of the key. A version rewrites only the buckets that its rows touch, into a folder of its own, and then writes a small
manifest that says which version each bucket is at. The manifest is the commit: readers take the newest one, a version that is written again (a
batch that a stream repeats) changes nothing once its manifest stands, and what a failed writer left behind is overwritten.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.session import materialise

BUCKETS = 16


class KeyedTable:
    """``keys`` are the key columns, ``value`` the column whose null deletes a key. One writer at a time; readers at any."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], value: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.value, self.buckets = spark, path.rstrip("/"), list(keys), value, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        top = self._at("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """bucket -> the version that holds it, of a version or the newest."""
        own = self.versions() if version is None else [version]
        if not own:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{own[-1]}.json").first()[0]
        return {int(b): v for b, v in json.loads(text).items()}

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, version: int, order: str | None = None) -> bool:
        """Puts rows into the table as ``version``; False if it stands already or a later one does. Of several rows of a key the last by ``order`` counts."""
        own = self.versions()
        if own and own[-1] >= version:
            return False
        if order is not None:
            last = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.desc(order)))
            rows = rows.withColumn("_rank", last).where("_rank = 1")
        rows = materialise(rows.select(*self.schema.names), "upsert")
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())
        before = self.manifest()
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        old = self._read({b: v for b, v in before.items() if b in touched}).alias("o").join(rows.alias("n"), same, "left_anti")
        new = old.unionByName(rows.where(F.col(self.value).isNotNull())).withColumn("bucket", self._bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        held = {b: v for b, v in before.items() if b not in touched}
        held |= {b: version for b in touched if self._fs.exists(self._at(f"data/version={version}/bucket={b}"))}
        self._commit(version, held)
        return True

    def _commit(self, version: int, manifest: dict[int, int]) -> None:
        """Written aside and renamed, so that a manifest is whole or not there."""
        aside, to = self._at(f"manifests/.{version}.tmp"), self._at(f"manifests/{version}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(aside, to):
            raise OSError(f"version {version} is there already")

    def compact(self, keep: int = 1) -> None:
        """Deletes all but the newest ``keep`` manifests, and the versions' buckets that none of these holds."""
        own = self.versions()
        held = {(v, b) for n in own[-keep:] for b, v in self.manifest(n).items()}
        for n in own[:-keep]:
            self._fs.delete(self._at(f"manifests/{n}.json"), False)
        top = self._at("data")
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
            v = int(folder.getPath().getName().split("=")[1])
            if own and v > own[-1]:
                continue  # a version that is being written
            for bucket in self._fs.listStatus(folder.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (v, int(name.split("=")[1])) not in held:
                    self._fs.delete(bucket.getPath(), True)
