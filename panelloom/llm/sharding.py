"""A store of immutable shards with size-tiered compaction, in DataFrame operations only.

Layout below the root: data/<name>/... holds Parquet shards that are never changed, manifest/<name> lists the shards of a
version, and commits/<number> names a version's manifest and the table's schema. A commit file is written aside, whole, and then put in
place by an operation that fails where the name is taken, so of several writers exactly one wins a number; the others
read the new version and try the next. Versions are expired together with the shards that only they list.
"""

from __future__ import annotations

import contextlib
import json
import os
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import P, hadoop_fs, remove

#: Shards are merged with shards of their tier only: sizes from target / RATIO**(t+1) to target / RATIO**t.
RATIO = 4
MANIFEST = "path string, bytes long, n_rows long, batch string"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a file with the content unless there is one; atomic, also in what others may read of it."""
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    fs, a = hadoop_fs(spark, aside)
    out = fs.create(a, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            # A rename on a local file system replaces, or looks before it leaps; a hard link does neither.
            local = urllib.parse.unquote(urllib.parse.urlparse(a.toUri().toString()).path)
            os.link(local, urllib.parse.unquote(urllib.parse.urlparse(hadoop_fs(spark, path)[1].toUri().toString()).path))
            return True
        jvm = spark._jvm
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(a, hadoop_fs(spark, path)[1], none)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(a, False)


class ShardStore:
    """Tables with any columns, null values and empty and very long texts; rows are never looked at, so repeated rows stay.

    Reading an empty table gives no rows of its schema. Rows that are appended must have the columns of the table.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, codec: str = "zstd"):
        self.spark, self.root, self.target, self.codec = spark, root.rstrip("/"), target_bytes, codec

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, ascending."""
        fs, p = hadoop_fs(self.spark, f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _commit_of(self, version: int) -> dict:
        if version not in self.versions():
            raise ValueError(f"version {version} does not exist or has expired")
        return json.loads(self.spark.read.text(f"{self.root}/commits/{version}", wholetext=True).first()[0])

    def _newest(self) -> int:
        done = self.versions()
        return done[-1] if done else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, n_rows, batch: the shards of a version, by default the newest; none in a store without versions."""
        version = self._newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._commit_of(version)['manifest']}")

    def _shards(self, folder: str, batch: str) -> DataFrame:
        """What a folder holds, from file metadata and row counts in the footers."""
        rows = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return rows.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("batch", F.lit(batch))

    def _commit(self, shards: DataFrame, expected: int, schema: StructType) -> int:
        """The version after expected, which must still be the newest."""
        name = uuid.uuid4().hex
        # One row per shard, not per row of the table.
        shards.select("path", "bytes", "n_rows", "batch").coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        fs, p = hadoop_fs(self.spark, f"{self.root}/commits")
        fs.mkdirs(p)
        if self._newest() != expected or not put_if_absent(self.spark, f"{self.root}/commits/{expected + 1}", json.dumps({"manifest": name, "schema": schema.json()})):
            remove(self.spark, f"{self.root}/manifest/{name}")
            raise Conflict(f"version {expected + 1} was committed by another writer")
        return expected + 1

    def append(self, df: DataFrame, batch_col: str | None = None) -> int:
        """Writes arrivals as small shards, as their tasks deliver them, and commits a version for each batch.

        With batch_col its values are the arrivals, in ascending order, nulls first; all are written in one pass over df, and the
        column stays in the table. An empty df commits a version without new shards.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if not batch_col:
            df.write.option("compression", self.codec).parquet(folder)
            return self._add(folder, "arrival", df.schema)
        by = f"{P}arrival"
        df.withColumn(by, F.col(batch_col)).write.option("compression", self.codec).partitionBy(by).parquet(folder)
        fs, p = hadoop_fs(self.spark, folder)
        values = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{by}=")]
        numeric = dict(df.dtypes)[batch_col] in ("tinyint", "smallint", "int", "bigint", "float", "double")

        def order(value: str):
            null = value == "__HIVE_DEFAULT_PARTITION__"
            return not null, (0.0 if null else float(value)) if numeric else urllib.parse.unquote(value)

        if not values:
            return self._add(None, "", df.schema)
        for value in sorted(values, key=order):
            version = self._add(f"{folder}/{by}={value}", value, df.schema)
        return version

    def _add(self, folder: str | None, batch: str, schema: StructType) -> int:
        shards = self._shards(folder, batch) if folder else None
        while True:
            newest = self._newest()
            if newest:
                known = StructType.fromJson(json.loads(self._commit_of(newest)["schema"]))
                if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in schema]:
                    raise ValueError(f"the table has the columns {known.simpleString()}, not {schema.simpleString()}")
            before = self.manifest(newest)
            try:
                return self._commit(before.unionByName(shards) if shards is not None else before, newest, schema)
            except Conflict:
                continue  # an arrival can follow any version

    def _tier(self):
        size = F.greatest(F.col("bytes"), F.lit(1)).cast("double")
        return F.greatest(F.floor(F.log(float(RATIO), F.lit(float(self.target)) / size)), F.lit(0)).cast("int")

    @contextlib.contextmanager
    def _packed_scans(self):
        """Scans whose tasks each get small files up to the target size."""
        conf = self.spark.conf
        names = {
            "spark.sql.files.maxPartitionBytes": str(self.target),
            "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1",
        }
        were = {k: conf.get(k, None) for k in names}
        try:
            for k, v in names.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in were.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def compact(self, most_shards: int = 20_000, retain: int = 1) -> int:
        """Merges shards of like size until no tier has two that fit into one file; returns the newest version.

        A commit takes at most most_shards shards of a tier; the loop goes on with the rest. The scan deals a tier's files, the
        largest first, over tasks of up to the target size, and each task writes one file: no shuffle. After each commit
        the versions before the newest `retain` ones expire; a reader of an old one must be done by then. A store without
        versions stays as it is (version 0).
        """
        stuck = set()
        while version := self._newest():
            schema = StructType.fromJson(json.loads(self._commit_of(version)["schema"]))
            small = self.manifest(version).filter(F.col("bytes") <= self.target // 2).withColumn(f"{P}tier", self._tier())
            tiers = [r for r in small.groupBy(f"{P}tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()]
            todo = sorted(r[0] for r in tiers if r["n"] > 1 and (r[0], r["n"], r["b"]) not in stuck)
            if not todo:
                break
            tier = todo[-1]
            stuck.add(next((r[0], r["n"], r["b"]) for r in tiers if r[0] == tier))
            chosen = small.filter(F.col(f"{P}tier") == tier).orderBy(F.col("bytes").desc(), "path").limit(most_shards)
            paths = [r["path"] for r in chosen.select("path").collect()]
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            with self._packed_scans():
                self.spark.read.schema(schema).parquet(*paths).write.option("compression", self.codec).parquet(folder)
            merged = self._shards(folder, f"merged-{tier}")
            if merged.count() >= len(paths):
                remove(self.spark, folder)
                continue
            rest = self.manifest(version).join(chosen.select("path"), "path", "left_anti")
            try:
                self._commit(rest.unionByName(merged), version, schema)
            except Conflict:
                remove(self.spark, folder)
                stuck.clear()
                continue
            self.expire(retain)
        return self._newest()

    def expire(self, retain: int = 1) -> None:
        """Forgets all but the newest `retain` versions, first their commits, then their manifests and the shards that only they list.

        A folder of shards that no version uses goes in one call; of a folder that is used in part, each shard in one.
        """
        versions = self.versions()
        old, new = versions[:-retain], versions[-retain:]
        if not old:
            return
        commits = {v: self._commit_of(v) for v in versions}
        listed = {v: self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{commits[v]['manifest']}").select("path") for v in versions}
        live = listed[new[0]]
        for v in new[1:]:
            live = live.unionByName(listed[v])
        gone = listed[old[0]]
        for v in old[1:]:
            gone = gone.unionByName(listed[v])
        folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
        dead = gone.distinct().join(live, "path", "left_anti").withColumn("folder", folder)
        used = live.select(folder).distinct()
        folders = [r[0] for r in dead.select("folder").distinct().join(used, "folder", "left_anti").toLocalIterator()]
        single = [r[0] for r in dead.join(used, "folder", "left_semi").select("path").toLocalIterator()]
        for v in old:
            remove(self.spark, f"{self.root}/commits/{v}")
        for path in [*folders, *single, *(f"{self.root}/manifest/{commits[v]['manifest']}" for v in old)]:
            remove(self.spark, path)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; shard_col, which must not be a column of the table, is to hold the name of a row's file.

        The driver lists the version's paths, as for any scan of files.
        """
        version = self._newest() if version is None else version
        schema = StructType.fromJson(json.loads(self._commit_of(version)["schema"]))
        if shard_col in schema.names:
            raise ValueError(f"the table has a column {shard_col}")
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if shard_col is None:
            return rows
        name = F.element_at(F.split("_metadata.file_path", "/"), -1) if paths else F.lit(None).cast("string")
        return rows.withColumn(shard_col, name)
