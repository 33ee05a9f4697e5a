"""Keyed tables on disk of which a change rewrites only the buckets that it touches.

A table is a folder with `data/<change>/_bucket=<n>` for the rows of bucket n as a change left them, and
`versions/<number>` with the manifest of each version: which folder holds each bucket, and which
batches are in it. Rows go to buckets by a hash of their key columns, that of Spark's own shuffles, so a task after one
by the keys has rows of few buckets. A change writes the changed buckets
to a folder of its own, then the next manifest beside the others, and renames that into its place: readers see
the version before or after it, never half of one, and of two changes at once the later one fails. Folders
of earlier versions stay until `vacuum`.

The driver handles bucket numbers only, of which there is a fixed number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.session import UNIQUE, collect_garbage, materialise

_BUCKET = "_bucket"
#: Parts in which buckets are gone through, one after the other, so that only the rows of one are on their way at once.
STEPS = 4


class Stored:
    """A stored table of rows with `schema`, keyed by the columns `keys` and bucketed by them, or by those of them in `by`.
    Null keys are keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64, by: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets, self.by = spark, path.rstrip("/"), schema, keys, buckets, by or keys

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """Number of the latest version; 0: none yet."""
        fs, at = self._fs(f"{self.path}/versions")
        return max([int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()], default=0) if fs.exists(at) else 0

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": {number: folder}, "batches": [names]} of a version, the latest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "batches": []}
        rows = self.spark.read.text(f"{self.path}/versions/{version}").collect()
        return json.loads(rows[0].value)

    def frame(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        folders = [f for n, f in sorted(self.manifest(version)["buckets"].items()) if only is None or int(n) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.hash(*self.by), F.lit(self.buckets)).cast("int"))

    def _publish(self, before: int, manifest: dict) -> None:
        folder = f"{self.path}/versions"
        draft = f"{folder}/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(draft)
        fs, to = self._fs(f"{folder}/{before + 1}")
        if fs.exists(to) or not fs.rename(self._fs(draft)[1], to):
            fs.delete(self._fs(draft)[1], True)
            raise RuntimeError(f"version {before + 1} of {self.path} was written by another change")

    def _numbers(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._dealt(rows.select(*self.by)).select(_BUCKET).distinct().collect())

    def change(self, touched: DataFrame, new: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None) -> bool:
        """Replace the buckets in which `touched` has keys by what `made` gives for their rows and the rows of `new`
        that go there. Whether a version was written: not if no bucket is touched, or the batch is in
        the table already."""
        version = self.version()
        manifest = self.manifest(version)
        if batch is not None and batch in manifest["batches"]:
            return False
        numbers = self._numbers(touched)
        if not numbers:
            return False
        own = self._dealt(new.select(*self.schema.names)).where(F.col(_BUCKET).isin(numbers)).drop(_BUCKET)
        rows = self._dealt(made(self.frame(version, numbers), own).select(*self.schema.names))
        return self._written(version, manifest, rows.repartition(_BUCKET), numbers, batch)

    def _written(self, version: int, manifest: dict, rows: DataFrame, numbers: list[int], batch: str | None) -> bool:
        """Write dealt rows in place of the buckets `numbers`, and the next manifest; not if there was and is nothing."""
        folder = f"data/{uuid.uuid4().hex}"
        written = self._put(rows, folder)
        kept = {n: f for n, f in manifest["buckets"].items() if int(n) not in numbers}
        if kept.keys() & written.keys():
            raise RuntimeError(f"the rows for {self.path} were others when they were read again")
        if not numbers and not written:
            return False
        self._publish(version, {"buckets": kept | written, "batches": manifest["batches"] + [batch] * (batch is not None)})
        return True

    def upsert(self, new: DataFrame, mutable: list[str], batch: str | None = None) -> bool:
        """Known keys take over the mutable columns, others are added; `new` has one row a key. Buckets in which
        nothing differs are left alone, so the same rows again write nothing."""
        new = materialise(new.select(*self.schema.names), "came")
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys))
        named = lambda rows: rows.withColumnsRenamed({c: f"_{c}" for c in self.schema.names})
        known = self.frame(only=self._numbers(new)).withColumn("_known", F.lit(True))
        other = reduce(or_, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in mutable), F.lit(False))
        differs = named(new).join(known, same, "left").where(F.col("_known").isNull() | other).select(*[F.col(f"_{k}").alias(k) for k in self.keys])

        def merged(old: DataFrame, own: DataFrame) -> DataFrame:
            j = old.withColumn("_known", F.lit(True)).join(named(own).withColumn("_came", F.lit(True)), same, "full_outer")
            taken = lambda c: F.col("_came").isNotNull() if c in mutable else F.col("_known").isNull()
            return j.select(*[F.when(taken(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in self.schema.names])

        return self.change(differs, new, merged, batch)

    def replace(self, new: DataFrame, batch: str | None = None) -> bool:
        """All rows of the keys that `new` has are replaced by its rows."""
        new = materialise(new.select(*self.schema.names), "came")
        keys = new.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys))
        return self.change(new, new, lambda old, own: old.join(keys, same, "left_anti").unionByName(own), batch)

    def _put(self, rows: DataFrame, folder: str, **options: str) -> dict[str, str]:
        """Write dealt rows below `folder`, beside those of other buckets; the folder of each bucket there."""
        rows.write.mode("append").partitionBy(_BUCKET).options(**options).parquet(f"{self.path}/{folder}")
        fs, at = self._fs(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def steps(self, numbers: list[int] | None = None) -> list[list[int]]:
        """The buckets, or those of `numbers`, in STEPS parts; empty ones are left out."""
        numbers = list(range(self.buckets)) if numbers is None else sorted(numbers)
        size = -(-self.buckets // STEPS)
        parts = [[n for n in numbers if n // size == k] for k in range(STEPS)]
        return [p for p in parts if p]

    def add(self, new: DataFrame, sums: list[str], batch: str | None = None) -> bool:
        """Numbers of equal keys are added up; `new` may have many rows a key. A batch that has a name counts once.

        The rows are made once, summed by one shuffle and written by the tasks that sum them. What they touch of the
        table is then summed with them, a part of the buckets at a time, so that never more than such a part is shuffled at
        once."""
        version = self.version()
        manifest = self.manifest(version)
        if batch is not None and batch in manifest["batches"]:
            return False
        total = [F.sum(c).cast(self.schema[c].dataType).alias(c) for c in sums]
        near = lambda rows: rows if self.by == self.keys else rows.repartition(*self.by)

        def summed(rows: DataFrame) -> DataFrame:
            return self._dealt(near(rows.select(*self.schema.names)).groupBy(*self.keys).agg(*total).select(*self.schema.names))

        came = self._put(summed(new), f"data/{uuid.uuid4().hex}", **UNIQUE)
        collect_garbage(self.spark)
        if not came:
            return False
        folder, merged = f"data/{uuid.uuid4().hex}", {}
        for part in self.steps([int(n) for n in came if n in manifest["buckets"]]):
            own = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{came[str(n)]}" for n in part])
            merged = self._put(summed(self.frame(version, part).unionByName(own)), folder, **UNIQUE)
            for n in part:
                fs, at = self._fs(f"{self.path}/{came[str(n)]}")
                fs.delete(at, True)
            collect_garbage(self.spark)
        self._publish(version, {"buckets": manifest["buckets"] | came | merged, "batches": manifest["batches"] + [batch] * (batch is not None)})
        return True

    def vacuum(self) -> int:
        """Delete the folders of buckets that the latest version does not have, and the manifests before it;
        how many folders of changes went whole."""
        version = self.version()
        held = set(self.manifest(version)["buckets"].values())
        fs, data = self._fs(f"{self.path}/data")
        gone = 0
        for change in fs.listStatus(data):
            name = change.getPath().getName()
            own = [f for f in fs.listStatus(change.getPath()) if f.isDirectory()]
            old = [f for f in own if f"data/{name}/{f.getPath().getName()}" not in held]
            if len(old) == len(own):
                fs.delete(change.getPath(), True)
                gone += 1
            else:
                for f in old:
                    fs.delete(f.getPath(), True)
        for n in range(1, version):
            at_fs, at = self._fs(f"{self.path}/versions/{n}")
            at_fs.delete(at, True)
        return gone
