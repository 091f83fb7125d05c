"""Keyed tables in a shared folder: rows lie in buckets of their key's hash, and a write touches only its buckets.

A table is Parquet files by bucket and a series of numbered manifests that name the folder of
each bucket. A write reads the buckets of its keys, writes their new state to folders of its
own and then creates the next manifest, which fails if another writer has created it before:
readers see all of a write or nothing, and what fails leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.classify import risk
from tidemark.operators import merge

_BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer has changed the table since it was read; nothing was written."""


class KeyedTable:
    """One row for each value of ``key`` (nulls are equal to each other), over files of a folder.

    The driver knows one folder name a bucket. Choose ``buckets`` by the size that the table will
    have: a bucket's rows are what a task rewrites.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, state = self._latest()
        self.key, self.buckets, self.folders = state["key"], state["buckets"], state["folders"]
        self.schema = T.StructType.fromJson(state["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64) -> KeyedTable:
        """An empty table; fails if there is one."""
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        _publish(spark, path.rstrip("/"), 0, {"key": key, "buckets": buckets, "folders": {}, "schema": nullable.jsonValue()})
        return cls(spark, path)

    def _latest(self) -> tuple[int, dict]:
        files, folder = _files(self.spark, f"{self.path}/manifests")
        names = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no table in {self.path}")
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifests/{names[-1]}").values().first()
        return int(names[-1].removesuffix(".json")), json.loads(text)

    def read(self) -> DataFrame:
        """All rows, as the manifest that this object knows says; a later write of others doesn't show."""
        return self._read(list(self.folders))

    def _read(self, buckets: list[str]) -> DataFrame:
        folders = [f"{self.path}/{self.folders[b]}" for b in buckets if b in self.folders]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")

    def write(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> KeyedTable:
        """The table after ``change(old rows, rows)`` in the buckets that ``rows`` have keys of; other buckets stay.

        ``rows`` have the key's columns at least. They are read twice, once for their buckets.
        """
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most one a bucket
        if not touched:
            return self
        new = change(self._read(touched), rows)
        new = new.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn(_BUCKET, self._bucket())
        place = f"data/{uuid.uuid4().hex}"
        new.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{place}")
        files, folder = _files(self.spark, f"{self.path}/{place}")
        written = {s.getPath().getName().split("=", 1)[1] for s in files.listStatus(folder) if "=" in s.getPath().getName()}
        folders = {b: f for b, f in self.folders.items() if b not in touched} | {b: f"{place}/{_BUCKET}={b}" for b in written}
        stray = written.difference(touched)
        if stray:
            raise ValueError("a change of rows must keep their keys")
        _publish(self.spark, self.path, self.number + 1, {"key": self.key, "buckets": self.buckets, "folders": folders, "schema": self.schema.jsonValue()})
        return KeyedTable(self.spark, self.path)

    def upsert(self, rows: DataFrame, order: str | None = None) -> KeyedTable:
        """``rows`` in place of those of their keys; of several of one key the one of greatest ``order``."""
        last = rows if order is None else merge.keep_last(rows, self.key, order)
        return self.write(last, lambda old, new: merge.upsert(old, new, self.key))

    def insert_new(self, rows: DataFrame, order: str) -> KeyedTable:
        """Rows of keys that the table doesn't have; others are left out."""
        return self.write(merge.keep_last(rows, self.key, order), lambda old, new: old.unionByName(new.join(old, merge._same(new, old, self.key, True), "left_anti"), allowMissingColumns=True))

    def update(self, rows: DataFrame) -> KeyedTable:
        """The columns of ``rows`` that are not null put in place of the table's; keys that it doesn't have are left out."""
        return self.write(rows, lambda old, new: merge.partial_update(old, new, self.key))

    def delete(self, keys: DataFrame) -> KeyedTable:
        return self.write(keys, lambda old, new: old.join(new, merge._same(old, new, self.key, True), "left_anti"))

    def drop_unused(self) -> int:
        """Deletes the data of earlier and of failed writes; readers of an earlier manifest lose theirs. Folders deleted."""
        used = {f.split("/")[1] for f in self.folders.values()}
        files, folder = _files(self.spark, f"{self.path}/data")
        gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in used] if files.exists(folder) else []
        for place in gone:
            files.delete(place, True)
        return len(gone)


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _publish(spark: SparkSession, path: str, number: int, state: dict) -> None:
    """Creates a manifest, which must be new: written apart first, so that no reader meets half of it."""
    files, folder = _files(spark, f"{path}/manifests")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json")
    apart = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}-{uuid.uuid4().hex}.part")
    files.mkdirs(folder)
    stream = files.create(apart, False)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    # A rename onto what is there fails, on file systems that overwrite so does the look before it.
    if files.exists(target) or not files.rename(apart, target):
        files.delete(apart, False)
        raise ConflictError(f"manifest {number} of {path} is there already")


def with_change_defaults(changes: DataFrame) -> DataFrame:
    """Change rows whose severity and confidence, where they have none, are those of their type."""
    told = risk(F.col("change_type"))
    have = {c: F.col(c) if c in changes.columns else F.lit(None) for c in ("severity", "confidence")}
    severity = F.coalesce(F.nullif(have["severity"].cast("string"), F.lit("")), told["severity"])
    return changes.withColumns({"severity": severity, "confidence": F.coalesce(have["confidence"].cast("double"), told["confidence"])})
