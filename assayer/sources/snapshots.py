"""Tables that change: numbered snapshots of Parquet folders, each a manifest of which folder holds which bucket of keys.

An update reads and rewrites only the buckets that its keys fall in. A commit is the creation of the next manifest,
which fails if another writer made it first. A mirror gets the same folders before that and the manifest after it; the
primary's manifests decide which version both have, so a failure in between leaves both at the version before or,
once the primary has the manifest, is made good by whoever opens the table next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer made the version that this one was to be."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 8, mirror: str | None = None):
        self.spark, self.folder, self.keys, self.buckets, self.mirror = spark, folder.rstrip("/"), keys, buckets, mirror and mirror.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self.repair()

    # files

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self, place: str) -> list[int]:
        fs, at = self._fs(f"{place}/versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def _text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, place: str, version: int, text: str) -> None:
        """Makes the version's manifest appear whole, and only if there is none."""
        fs, draft = self._fs(f"{place}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, target = self._fs(f"{place}/versions/{version}")
        fs.mkdirs(target.getParent())
        try:
            if fs.getScheme() == "file":  # renaming would replace a file there; a link doesn't
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(target), local(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, none)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} of {place} is there already") from None
            raise
        finally:
            fs.delete(draft, False)

    def repair(self) -> None:
        """Gives the mirror the manifests that only the primary has."""
        if self.mirror:
            have = set(self._versions(self.mirror))
            for version in self._versions(self.folder):
                if version not in have:
                    self._publish(self.mirror, version, self._text(f"{self.folder}/versions/{version}"))

    # reading

    def version(self) -> int:
        """The newest; 0 if there is none."""
        return max(self._versions(self.folder), default=0)

    def manifest(self, version: int, place: str | None = None) -> dict[str, str]:
        """bucket -> its folder's name."""
        return json.loads(self._text(f"{place or self.folder}/versions/{version}")) if version else {}

    def read(self, version: int | None = None, from_mirror: bool = False, buckets: list[int] | None = None) -> DataFrame:
        place = self.mirror if from_mirror else self.folder
        version = max(self._versions(place), default=0) if version is None else version
        paths = [f"{place}/data/{name}" for k, name in self.manifest(version, place).items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commit(self, base: int, change: Callable[[DataFrame], DataFrame], touched: DataFrame) -> int:
        """Replaces the buckets of touched's keys with what change makes of their rows; fails if base isn't the newest any more."""
        hit = sorted(r.b for r in touched.select(self._bucket().alias("b")).distinct().collect())  # at most one for each bucket
        if not hit:
            return base
        old = self.manifest(base)
        new = change(self.read(base, buckets=hit)).select(*self.schema.names)
        name = uuid.uuid4().hex
        new.withColumn("_bucket", self._bucket()).repartition(len(hit), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
        if self.mirror and self._filled(name):  # the same rows under the same names
            self.spark.read.parquet(f"{self.folder}/data/{name}").repartition(len(hit), "_bucket").write.partitionBy("_bucket").parquet(f"{self.mirror}/data/{name}")
        kept = {k: v for k, v in old.items() if int(k) not in hit}
        made = {k: f"{name}/_bucket={k}" for k in self._filled(name)}
        try:
            self._publish(self.folder, base + 1, json.dumps(kept | made))
        except Conflict:
            for place in filter(None, (self.folder, self.mirror)):
                fs, at = self._fs(f"{place}/data/{name}")
                fs.delete(at, True)
            raise
        self.repair()
        return base + 1

    def _filled(self, name: str) -> list[str]:
        fs, at = self._fs(f"{self.folder}/data/{name}")
        return [x.getPath().getName().split("=")[1] for x in fs.listStatus(at) if x.getPath().getName().startswith("_bucket=")]

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        """rows, whose keys are unique, in place of those with their keys."""
        keys = rows.select(*self.keys)
        return self.commit(self.version() if base is None else base, lambda old: old.join(keys, self.keys, "left_anti").unionByName(rows.select(*self.schema.names)), rows)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        gone = keys.select(*self.keys).distinct()
        return self.commit(self.version() if base is None else base, lambda old: old.join(gone, self.keys, "left_anti"), gone)


def retried(change: Callable[[int], int], table: Snapshots, times: int = 20) -> int:
    """change(base) on the newest version, again on a newer one if another writer was first."""
    for _ in range(times):
        try:
            return change(table.version())
        except Conflict:
            continue
    raise Conflict(f"other writers were first {times} times")
