"""Size-tiered shards under a versioned manifest.

Arrivals are written as small immutable Parquet files. Files of similar size form a tier; a tier with
enough of them is merged into files of the target size. Each change is one new manifest version, created
by an atomic rename that fails if that version exists: readers see a whole version or the one before, and
of two writers one must try again. Files go only when no kept version names them.

A version is a small JSON file that names Parquet segments: lists of files that were added or dropped since the last
checkpoint, a segment with all of them. Spark lists, writes, joins and counts these; the driver sees a tier's totals.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hadoop, written

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Segments of a version from which on it gets a checkpoint, and files that one merge takes at most (the next takes the others).
SEGMENTS, MERGE_FILES = 16, 10_000
#: Schemes of stores whose rename is atomic and fails where the target exists.
ATOMIC = {"file", "hdfs", "viewfs", "abfs", "abfss"}

SHARDS = "path string, bytes long, part string"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table of shards in a folder.

    target_bytes is the size of merged files, fanout both the least number of files that a tier is merged at
    and the ratio between the sizes of tiers. Commits need a store with an atomic rename (ATOMIC; object stores such as s3a
    and gs copy instead); elsewhere single_writer=True says that no other writer is at work.
    """

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, single_writer: bool = False):
        if fanout < 2 or target_bytes < 1:
            raise ValueError("fanout must be 2 or more, and target_bytes positive")
        self.spark, self.folder, self.target, self.fanout = spark, folder, target_bytes, fanout
        scheme = str(hadoop(spark, folder)[0].getUri().getScheme())
        if scheme not in ATOMIC and not single_writer:
            raise ValueError(f"a rename in {scheme} isn't atomic: say single_writer=True if no other writer is at work")

    def _listing(self, place: str) -> DataFrame:
        """path and bytes of the data files below a folder, listed by Spark; their contents aren't read."""
        fs, path = hadoop(self.spark, place)
        if not fs.exists(path):
            return self.spark.createDataFrame([], "path string, bytes long")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(place)
        return found.select("path", F.col("length").alias("bytes"))

    def _segment(self, shards: DataFrame) -> str:
        """Writes a list of files (path, bytes, part); its name."""
        name = uuid.uuid4().hex
        written(shards.select("path", "bytes", "part"), f"{self.folder}/segments/{name}")
        return name

    def _files(self, segments: list[list[str]]) -> DataFrame:
        """path and bytes of the files that [segment, part] pairs name; a part of '*' is all of them."""
        by_name: dict[str, list[str]] = {}
        for name, part in segments:
            by_name.setdefault(name, []).append(part)

        def files(name: str, parts: list[str]) -> DataFrame:
            listed = self.spark.read.schema(SHARDS).parquet(f"{self.folder}/segments/{name}")
            return (listed if "*" in parts else listed.where(F.col("part").isin(parts))).select("path", "bytes")

        found = [files(name, parts) for name, parts in by_name.items()]  # a segment is read once, whichever of its parts are named
        return reduce(DataFrame.unionAll, found) if found else self.spark.createDataFrame([], "path string, bytes long")

    def versions(self) -> list[int]:
        fs, path = hadoop(self.spark, f"{self.folder}/manifest")
        return sorted(int(f.getPath().getName()[1:-5]) for f in fs.listStatus(path) if f.getPath().getName().startswith("v")) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, note, adds, drops} of a version, by default the last: segments as [name, part]. Version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "note": "", "adds": [], "drops": []}
        fs, path = hadoop(self.spark, f"{self.folder}/manifest/v{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> DataFrame:
        """path and bytes of the files of a version, by default the last."""
        return self._shards(self.manifest(version))

    def _shards(self, base: dict) -> DataFrame:
        adds = self._files(base["adds"])
        return adds.join(self._files(base["drops"]).select("path"), "path", "left_anti") if base["drops"] else adds

    def commit(self, base: dict, adds: list[list[str]], drops: list[list[str]], note: str, schema: str | None = None) -> dict:
        """Makes the version after `base`, which adds and drops the files of segments; raises Conflict if it exists."""
        found = {"version": base["version"] + 1, "schema": schema or base["schema"], "note": note, "adds": base["adds"] + adds, "drops": base["drops"] + drops}
        if len(found["adds"]) + len(found["drops"]) > SEGMENTS:
            found |= {"adds": [[self._segment(self._shards(found).withColumn("part", F.lit("*"))), "*"]], "drops": []}
        fs, draft = hadoop(self.spark, f"{self.folder}/manifest/draft-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        stream = fs.create(draft, False)
        stream.write(json.dumps(found).encode("utf-8"))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        final = hadoop(self.spark, f"{self.folder}/manifest/v{found['version']:012d}.json")[1]
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, no_overwrite)
        except Exception as e:
            if fs.exists(final):
                fs.delete(draft, False)
                raise Conflict(f"version {found['version']} exists") from e
            raise
        return found

    def append(self, df: DataFrame, arrival=None) -> int:
        """Writes the rows as small shards; the last version made.

        `arrival`, a column, tells arrivals apart: they are written in one pass and committed one version each,
        in ascending order, that of null last. Without it the rows are one arrival. All columns and rows are kept as they are,
        nulls and repeats too, whatever the columns' names. The schema must be that of the rows before. No
        rows, no version.
        """
        base = self.manifest()
        schema = df.schema.json()
        if base["schema"] and T.StructType.fromJson(json.loads(base["schema"])).simpleString() != df.schema.simpleString():
            raise ValueError("these rows' schema differs from the table's")
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        own = "_arrival_" + uuid.uuid4().hex[:8]
        if arrival is None:
            df.write.option("compression", "zstd").parquet(place)
            part = F.lit("")
        else:
            df.withColumn(own, arrival.cast("long")).write.option("compression", "zstd").partitionBy(own).parquet(place)
            part = F.regexp_extract("path", f"{own}=([^/]*)/", 1)
        segment = self._segment(self._listing(place).withColumn("part", part))
        listed = self.spark.read.schema(SHARDS).parquet(f"{self.folder}/segments/{segment}")
        keys = [r["part"] for r in listed.groupBy("part").agg(F.count("*")).orderBy(F.col("part").try_cast("long").asc_nulls_last()).collect()]  # one for each arrival
        for key in keys:
            base = self.commit(base, [[segment, key]], [], f"append {key}".strip(), schema)
        return base["version"]

    def tier(self, size):
        """How often the target size must be divided by the fanout to reach a file of this size (a number or a column)."""
        if isinstance(size, int):
            return max(0, math.ceil(math.log(self.target / max(1, size), self.fanout) - 1e-9))
        steps = F.log(F.lit(float(self.target)) / F.greatest(size, F.lit(1))) / F.lit(math.log(self.fanout))
        return F.greatest(F.ceil(steps - 1e-9), F.lit(0)).cast("int")

    def compact(self) -> int:
        """Merges tiers, the smallest files first, until none has `fanout` files below half the target size; the last version.

        A store without rows, or without a full tier, stays as it is.
        """
        base = self.manifest()
        while True:
            small = self._shards(base).where(F.col("bytes") < self.target // 2).withColumn("tier", self.tier(F.col("bytes")))
            full = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fanout).agg(F.max("tier")).first()[0]
            if full is None:
                return base["version"]
            gone = self._segment(small.where(F.col("tier") == full).orderBy("path").limit(MERGE_FILES).withColumn("part", F.lit("*")))
            runs = self._files([[gone, "*"]])
            total, n = runs.agg(F.sum("bytes"), F.count("*")).first()
            place = f"{self.folder}/data/{uuid.uuid4().hex}"
            self._read(base, runs).coalesce(max(1, math.ceil(total / self.target))).write.option("compression", "zstd").parquet(place)
            made = self._segment(self._listing(place).withColumn("part", F.lit("*")))
            base = self.commit(base, [[made, "*"]], [[gone, "*"]], f"merge {n} of tier {full}")

    def _read(self, base: dict, shards: DataFrame) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        paths = [r["path"] for r in shards.select("path").sort("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the last.

        The driver holds the paths of the version's files, as Spark's file index does for any table. Rows come back as they were appended, nulls and repeats too; a
        store without a version is an error.
        """
        base = self.manifest(version)
        if not base["schema"]:
            raise ValueError("an empty store has no schema")
        return self._read(base, self._shards(base))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data files that none of the last `keep` versions names, their segments, and older manifests; data files deleted.

        For a time when no writer is at work: a write under way isn't named yet.
        """
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        live = reduce(DataFrame.unionAll, [self._shards(m).select("path") for m in kept]) if kept else self.spark.createDataFrame([], "path string")
        gone = [r["path"] for r in self._listing(f"{self.folder}/data").join(live, "path", "left_anti").select("path").toLocalIterator()]
        used = {name for m in kept for name, _ in m["adds"] + m["drops"]}
        fs, place = hadoop(self.spark, f"{self.folder}/segments")
        segments = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName() not in used] if fs.exists(place) else []
        for path in gone + [f"{self.folder}/manifest/v{v:012d}.json" for v in versions[:-keep]]:
            fs.delete(hadoop(self.spark, path)[1], False)
        for path in segments:
            fs.delete(path, True)
        return len(gone)
