"""A keyed table that is written, changed and cleaned in place: hashed buckets, and a manifest a version.

A change writes the buckets that it touches to a new folder, and then the next manifest, which names a folder for each
bucket. Readers follow the last manifest, so a change is seen whole or not at all; what a failed one wrote is named
nowhere, and ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skyloom.staging import freed, stored


class Conflict(RuntimeError):
    """Another writer has switched to the version that this one was about to write."""


class Store:
    """Rows by a unique ``key`` under ``path``, in ``buckets`` parts; a store that exists keeps the number it was made with."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets = (self._manifest() or {}).get("buckets", buckets)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        """All versions whose manifest is whole, the oldest first."""
        return [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json") and n[0].isdigit()]

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{version:012d}.json").collect())
        return json.loads(text)

    def _switch(self, version: int, folders: dict[str, str], schema: StructType) -> None:
        """Write the manifest beside its place, and move it there; Conflict if there is one."""
        made = {"version": version, "key": self.key, "buckets": self.buckets, "folders": folders, "schema": json.loads(schema.json())}
        fs, draft = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        place = self._fs(f"{self.path}/manifests/{version:012d}.json")[1]
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of the last version or of a given one; None before the first."""
        held = self._manifest(version)
        return None if held is None else self._rows(held, sorted(held["folders"])).drop("_bucket")

    def _rows(self, held: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        folders: dict[str, list[int]] = {}
        for b in buckets:
            if b in held["folders"]:
                folders.setdefault(held["folders"][b], []).append(int(b))
        wide = StructType([*schema.fields, StructField("_bucket", IntegerType())])
        out = self.spark.createDataFrame([], wide)
        for folder, some in folders.items():
            paths = [f"{self.path}/data/{folder}/_bucket={b}" for b in some]
            # columns that came after a folder was written are null in it
            out = out.unionByName(self.spark.read.option("basePath", f"{self.path}/data/{folder}").schema(wide).parquet(*paths))
        return out

    def _write(self, rows: DataFrame, held: dict | None, touched: list[int]) -> None:
        """``rows`` in place of the ``touched`` buckets, as the next version."""
        version = (held["version"] if held else 0) + 1
        folder = f"{version:012d}-{uuid.uuid4().hex}"
        schema = rows.drop("_bucket").schema
        rows.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        there = {int(n.split("=")[1]) for n in self._names(f"data/{folder}") if n.startswith("_bucket=")}
        folders = {b: f for b, f in (held["folders"] if held else {}).items() if int(b) not in touched}
        self._switch(version, folders | {str(b): folder for b in sorted(there)}, schema)

    def upsert(self, new: DataFrame) -> dict[str, int]:
        """Rows of ``new`` replace those of their keys, others are added; how many of each. Null keys take no part.

        Of several rows of a key in ``new`` one is taken. Columns that only one side has are null on the other. Only the
        buckets of the keys of ``new`` are read and written.
        """
        held = self._manifest()
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        dealt = stored(new.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn("_bucket", bucket), "upsert")
        sizes = {r[0]: r[1] for r in dealt.groupBy("_bucket").count().collect()}
        if not sizes and held:
            return {"inserted": 0, "updated": 0}
        total, updated, rows = sum(sizes.values()), 0, dealt
        if held:
            old = self._rows(held, [str(b) for b in sizes])
            same = dealt.select("_bucket", self.key)
            updated = old.join(same, ["_bucket", self.key], "left_semi").count()
            rows = old.join(same, ["_bucket", self.key], "left_anti").unionByName(dealt, allowMissingColumns=True)
        self._write(rows, held, list(sizes))
        freed(dealt)
        return {"inserted": total - updated, "updated": updated}

    def delete(self, where: Column) -> int:
        """Rows that meet ``where`` go; how many. Only buckets that hold one are written."""
        held = self._manifest()
        if not held:
            return 0
        gone = {r[0]: r[1] for r in self._rows(held, list(held["folders"])).filter(where).groupBy("_bucket").count().collect()}
        if gone:
            left = self._rows(held, [str(b) for b in gone]).filter(~F.coalesce(where, F.lit(False)))
            self._write(left, held, list(gone))
        return sum(gone.values())

    def expire(self, column: str, now: Column, days: int = 0) -> int:
        """Rows whose ``column`` lies ``days`` or more before ``now`` go; null times stay."""
        return self.delete(F.col(column) < now - F.make_interval(days=F.lit(days)))

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` manifests and every folder that none of those names; how many folders went."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self._manifest(v)["folders"].values()}
        for v in known[:-keep]:
            fs, at = self._fs(f"{self.path}/manifests/{v:012d}.json")
            fs.delete(at, False)
        gone = [f for f in self._names("data") if f not in named]
        for f in gone:
            fs, at = self._fs(f"{self.path}/data/{f}")
            fs.delete(at, True)
        return len(gone)
