"""A keyed table that many runs share: what a run adds is a delta, and a manifest says which deltas count.

Deltas are folders of Parquet by key bucket. A run writes its delta, then a manifest with the next number that names it; until
then no reader sees it, and a run that fails leaves nothing that counts. Two runs that write at once cannot both get a number: the
later one fails and may try again. A lookup reads only the buckets of the keys that it asks for. Compaction writes one folder in
place of all deltas; what no manifest names any more is removed by `tidy`.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """`schema`: all columns; `keys`: those that a row is known by, null being a value; `lead`: keys that are folders of their own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], lead: tuple[str, ...] = (), buckets: int = 32) -> None:
        self.spark, self.path, self.keys, self.lead, self.buckets = spark, path.rstrip("/"), keys, lead, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()

    # -- manifests --------------------------------------------------------------------------------------------------

    def _file(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict]:
        """The latest manifest's number, and what it says: `versions` that count, `tags` of what was put; 0 if there is none."""
        folder, fs = self._file("_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        if not number:
            return 0, {"versions": [], "tags": {}}
        target, fs = self._file(f"_manifests/{number:012d}.json")
        stream = fs.open(target)
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> None:
        """Write the manifest under the number, unless another run has taken it."""
        fresh, fs = self._file(f"_manifests/{uuid.uuid4().hex}.new")
        target, _ = self._file(f"_manifests/{number:012d}.json")
        stream = fs.create(fresh, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise RuntimeError(f"another run has written manifest {number} of {self.path}")

    # -- reading ----------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        # a null key is marked by a value of its own, so that (null, x) and (x, null) are told apart
        return F.pmod(F.xxhash64(*[x for k in self.keys for x in (F.col(k), F.col(k).isNull())]), F.lit(self.buckets)).cast("int")

    def _rows(self, versions: list[str]) -> DataFrame:
        """The rows of the versions, with version_number and key_bucket."""
        inner = [f for f in self.schema if f.name not in self.lead]
        full = T.StructType([*inner, T.StructField("version_number", T.LongType()), T.StructField("run", T.StringType()), *[self.schema[c] for c in self.lead], T.StructField("key_bucket", T.IntegerType())])
        if not versions:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/{v}" for v in versions])

    def read(self, where: Column | None = None) -> DataFrame:
        """The newest row of every key; `where` may only name `lead` columns and `key_bucket`, and picks the folders that are read."""
        rows = self._rows(self.manifest()[1]["versions"])
        rows = rows if where is None else rows.where(where)
        rest = [c for c in self.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *rest), "version_number").alias("r"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"r.{c}") for c in self.columns])

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys; only their buckets are read. The buckets' numbers, and nothing else, go through the driver."""
        asked = wanted.select(*self.keys).distinct()
        buckets = [r[0] for r in asked.select(self.bucket()).distinct().collect()]
        found = self.read(F.col("key_bucket").isin(buckets))
        same = reduce(lambda a, b: a & b, (found[k].eqNullSafe(asked[k]) for k in self.keys))
        return found.join(asked, same, "left_semi")

    # -- writing ----------------------------------------------------------------------------------------------------

    def _store(self, rows: DataFrame, number: int) -> str:
        """Write rows with key_bucket to a folder of this run's own; what a failed run left there is named by no manifest."""
        version = f"version_number={number}/run={uuid.uuid4().hex}"
        rows.repartition(*self.lead, "key_bucket").write.partitionBy(*self.lead, "key_bucket").option("compression", "zstd").parquet(f"{self.path}/{version}")
        return version

    def put(self, rows: DataFrame, tag: str | None = None, place: int = 0) -> bool:
        """Add rows, or replace those with their keys; whether anything was written.

        Of several rows with one key the greatest counts. Rows that are there already as they are are not written again, and if
        none is left there is no new version. `tag` and `place`: what was put under the tag at this place or a later one is not
        put again, so that a batch that is run again after a failure changes nothing.
        """
        number, manifest = self.manifest()
        if tag is not None and manifest["tags"].get(tag, -1) >= place:
            return False
        rest = [c for c in self.columns if c not in self.keys]
        once = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        once = once.groupBy(*self.keys).agg(F.max(F.struct(F.lit(0).alias("_"), *rest)).alias("r")).select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        there = self.look_up(once)
        same = reduce(lambda a, b: a & b, (once[c].eqNullSafe(there[c]) for c in self.columns))
        changed = once.join(there, same, "left_anti").withColumn("key_bucket", self.bucket())
        version = self._store(changed, number + 1)
        target, fs = self._file(version)
        wrote = any(s.isDirectory() for s in fs.listStatus(target))
        if not wrote:
            fs.delete(target, True)
        if not wrote and tag is None:
            return False
        tags = manifest["tags"] | ({tag: place} if tag is not None else {})
        self._commit(number + 1, {"versions": [*manifest["versions"], *([version] if wrote else [])], "tags": tags})
        return wrote

    def compact(self) -> None:
        """One version in place of all; readers of the earlier ones are not disturbed until `tidy`."""
        number, manifest = self.manifest()
        if len(manifest["versions"]) < 2:
            return
        version = self._store(self.read().withColumn("key_bucket", self.bucket()), number + 1)
        self._commit(number + 1, manifest | {"versions": [version]})

    def tidy(self) -> None:
        """Remove versions and manifests that the latest manifest does not need; to be called when no one reads or writes."""
        number, manifest = self.manifest()
        pattern, fs = self._file("version_number=*/run=*")
        for status in fs.globStatus(pattern) or () if number else ():
            if "/".join(str(status.getPath()).split("/")[-2:]) not in manifest["versions"]:
                fs.delete(status.getPath(), True)
        folder, fs = self._file("_manifests")
        for status in fs.listStatus(folder) if number else ():
            if status.getPath().getName() != f"{number:012d}.json":
                fs.delete(status.getPath(), False)
