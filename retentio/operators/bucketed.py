"""A hash-bucketed table in which an upsert rewrites only the buckets it touches (SNK1, STR4).

A row lies in the bucket that a hash of its key names. Version ``v`` of the
table is a manifest: for each bucket with rows, the version whose folder holds
them (``data/v=<version>/bucket__=<bucket>``). An upsert reads the touched buckets,
merges the source into them by the same rule as ``quality.upsert``, writes them
under the next version and then writes the next manifest, in which all other
buckets still point to their old folders. A manifest counts once its write has
committed (``_SUCCESS``), so a crash at any moment leaves the last complete
version; the retry overwrites what the crash left. Each manifest also names the
last batch of every feed that it holds: a replayed batch changes nothing.

The manifest has one row per bucket and is the only thing the driver reads.
One job at a time may write; readers keep the version they opened until
``vacuum`` drops it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_folder, folder_names, path_exists
from .quality import upsert

_PART = "bucket__"
_MANIFEST = "bucket int, version long, buckets int, key string, schema string, applied string"


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # -- versions ------------------------------------------------------------
    def _manifest_path(self, version: int) -> str:
        return os.path.join(self.path, "manifest", f"v={version:012d}")

    def _data_path(self, version: int, bucket: int | None = None) -> str:
        at = os.path.join(self.path, "data", f"v={version:012d}")
        return at if bucket is None else os.path.join(at, f"{_PART}={bucket}")

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        named = folder_names(self.spark, os.path.join(self.path, "manifest"))
        found = [int(n[2:]) for n in named if n.startswith("v=")]
        return [v for v in found if path_exists(self.spark, os.path.join(self._manifest_path(v), "_SUCCESS"))]

    def manifest(self, version: int | None = None) -> dict:
        """buckets, key, schema, applied and folders (bucket -> version) of a version (the last one)."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no committed version under {self.path}")
        version = known[-1] if version is None else version
        rows = self.spark.read.schema(_MANIFEST).json(self._manifest_path(version)).collect()  # one row per bucket
        first = rows[0]
        return {"version": version, "buckets": first["buckets"], "key": first["key"], "schema": first["schema"],
                "applied": json.loads(first["applied"]), "folders": {r["bucket"]: r["version"] for r in rows if r["version"] is not None}}

    def _commit(self, version: int, m: dict) -> None:
        same = (m["buckets"], m["key"], m["schema"], json.dumps(m["applied"]))
        rows = [(b, v, *same) for b, v in sorted(m["folders"].items())] or [(-1, None, *same)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(self._manifest_path(version))

    def _bucket(self, key: str, buckets: int):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, key: str, buckets: int, version: int) -> list[int]:
        """Write rows under a version; the buckets that got rows."""
        at = self._data_path(version)
        df.withColumn(_PART, self._bucket(key, buckets)).repartition(_PART).write.mode("overwrite").partitionBy(_PART).parquet(at)
        return self._buckets_in(version)

    def _buckets_in(self, version: int) -> list[int]:
        return [int(n.split("=")[1]) for n in folder_names(self.spark, self._data_path(version)) if n.startswith(f"{_PART}=")]

    # -- reading -------------------------------------------------------------
    def _read(self, m: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        mine = [self._data_path(v, b) for b, v in sorted(m["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*mine) if mine else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    # -- writing -------------------------------------------------------------
    def create(self, df: DataFrame, key: str, buckets: int) -> None:
        """Version 0, unless it is committed already."""
        if self.versions():
            return
        got = self._write(df, key, buckets, 0)
        self._commit(0, {"buckets": buckets, "key": key, "schema": df.schema.json(), "applied": {}, "folders": {b: 0 for b in got}})

    def upsert(self, source: DataFrame, keep_first: Sequence[str] = (), order: str | None = None,
               feed: str = "", batch: int | None = None) -> dict:
        """Merge ``source``; the manifest after it. With a batch number, a batch up to the last applied one of its feed is a replay."""
        m = self.manifest()
        if batch is not None and batch <= m["applied"].get(feed, -1):
            return m
        key, version = m["key"], m["version"] + 1
        named = source.withColumn(_PART, self._bucket(key, m["buckets"]))
        touched = {r[0] for r in named.select(_PART).distinct().collect()}  # at most as many rows as buckets
        merged = upsert(self._read(m, touched), source, key, keep_first=keep_first, order=order)
        got = self._write(merged, key, m["buckets"], version) if touched else []
        m["folders"] = {b: v for b, v in m["folders"].items() if b not in touched} | {b: version for b in got}
        if batch is not None:
            m["applied"][feed] = batch
        self._commit(version, m)
        return {**m, "version": version}

    def vacuum(self, keep: int = 2) -> int:
        """Drop bucket folders and manifests that none of the last ``keep`` versions needs; how many bucket folders went."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-max(1, keep):]]
        needed = {(v, b) for m in kept for b, v in m["folders"].items()}
        for v in known[: -max(1, keep)]:
            delete_folder(self.spark, self._manifest_path(v))
        gone = 0
        for n in folder_names(self.spark, os.path.join(self.path, "data")):
            v = int(n[2:])
            if v > known[-1]:
                continue
            for b in self._buckets_in(v):
                if (v, b) not in needed:
                    delete_folder(self.spark, self._data_path(v, b))
                    gone += 1
        return gone
