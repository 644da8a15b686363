"""A versioned table with keys: merges that rewrite the touched buckets only, and readers that never see half of one.

Rows lie in buckets by the hash of their key, each bucket a folder of Parquet
files that is never changed.  A version is a manifest, a small file that names
the folder of each bucket; a writer makes new folders first and then the next
manifest, which takes its name in one step and only where the name is free (the
store must rename files in one step).  So of two writers one wins, and a reader
has either version whole.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import upsert

BUCKETS = 64
_AT = "__bucket"


class Conflict(RuntimeError):
    """Another writer was first; read again and repeat."""


class KeyedTable:
    """The table at path; keys and the number of buckets are those of its first version."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        held = self._manifest()
        if held is None and not keys:
            raise ValueError("a new table needs keys")
        if held and keys and list(keys) != held["keys"]:
            raise ValueError(f"the table's keys are {held['keys']}")
        self.keys, self.buckets = (held["keys"], held["buckets"]) if held else (list(keys), buckets)

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        files, folder = self._file("versions")
        return sorted(int(m[1]) for f in (files.listStatus(folder) if files.exists(folder) else ()) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName())))

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version if version is not None else known[-1]}.json", wholetext=True).first()[0])

    def _commit(self, held: dict | None, schema: T.StructType, folders: dict[str, str]) -> int:
        version = held["version"] + 1 if held else 0
        files, path = self._file(f"versions/{version}.json")
        body = json.dumps({"version": version, "keys": self.keys, "buckets": self.buckets, "schema": schema.json(), "folders": folders})
        _, aside = self._file(f"versions/.{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(bytearray(body.encode()))
        out.close()
        # A whole file takes its name in one step; where the name is taken it stays away.
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, False)
            raise Conflict(f"version {version} exists")
        return version

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, held: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        paths = sorted(f for b, f in held["folders"].items() if buckets is None or int(b) in buckets)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given.  A table without versions is an error."""
        held = self._manifest(version)
        if held is None:
            raise ValueError("the table is empty: it has no version")
        return self._read(held)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Folders of the buckets that rows fall into; one task writes each bucket's file."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_AT, self._bucket()).repartition(self.buckets, _AT).write.partitionBy(_AT).parquet(f"{self.path}/{name}")
        files, folder = self._file(name)
        found = [m[1] for f in files.listStatus(folder) if (m := re.fullmatch(rf"{_AT}=(\d+)", f.getPath().getName()))]
        return {b: f"{name}/{_AT}={b}" for b in found}

    def merge(self, new: DataFrame, order: list[str] | None = None) -> int:
        """Rows of new replace or join those with their keys, of equal keys the last by order; the new version's number.

        Columns that only one side has are null on the other.  Null keys are
        keys.  An empty table of new rows makes a version like the last.
        """
        held = self._manifest()
        if held is None:
            last = upsert(new.limit(0), new, self.keys, order)
            return self._commit(None, new.schema, self._write(last))
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets
        merged = _null_safe_upsert(self._read(held, touched), new, self.keys, order)
        return self._commit(held, merged.schema, {**{b: f for b, f in held["folders"].items() if int(b) not in touched}, **self._write(merged)})

    def replace(self, new: DataFrame, order: list[str] | None = None) -> int:
        """All rows go and new ones come, in one version (delete-all and load)."""
        last = upsert(new.limit(0), new, self.keys, order)
        return self._commit(self._manifest(), new.schema, self._write(last))

    def delete(self, gone: DataFrame | None = None) -> int:
        """The rows with the keys of gone go, all without it."""
        held = self._manifest()
        if held is None:
            raise ValueError("the table is empty: it has no version")
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        if gone is None:
            return self._commit(held, schema, {})
        keys = gone.select(*self.keys).distinct()
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        left = self._read(held, touched).join(keys.select(*(F.col(k).alias(f"__{k}") for k in self.keys)), _same(self.keys), "left_anti")
        return self._commit(held, schema, {**{b: f for b, f in held["folders"].items() if int(b) not in touched}, **self._write(left)})


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def _null_safe_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """upsert() in which null keys are keys."""
    last = upsert(new.limit(0), new, keys, order)
    kept = old.join(last.select(*(F.col(k).alias(f"__{k}") for k in keys)), _same(keys), "left_anti")
    return last.unionByName(kept, allowMissingColumns=True)
