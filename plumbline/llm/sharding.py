"""Size-tiered compaction of immutable shards under a versioned manifest.

An append writes its rows as small Parquet shards and adds them to the manifest.
Compaction sorts shards into tiers, each four times as large as the one below,
fills groups of similarly sized shards up to the target size, and rewrites each
group of ``min_merge`` or more as one file.  Files never change.  What a reader
sees is the newest manifest; a writer commits by renaming a finished manifest to
the next version number, which fails if another writer was first, so a reader or a
crash never meets half a change.  That needs a file system whose rename is atomic
and refuses an existing target (HDFS, a local disk; an object store needs its own
committer).  An append that lost the race adds its shards to the version that won;
a compaction replaces its inputs in that version if they are all still there,
since files never change, and gives up only where another compaction took one.  Files that no kept
version names are removed by `vacuum` once they are too old to belong to an
append or a compaction that is still at work.

The manifest has one entry a file; rows never pass the driver.

Defined cases: nulls, repeated rows and columns of any names are kept as they are;
an empty append adds nothing; an empty store reads as no rows.  The column that
tells a row's file is ``shard``, with underscores after it where the table has
such a column.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Shard:
    file: str  # relative to the store
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]


class Conflict(RuntimeError):
    """Another writer committed first."""


def tier(size: int, base: int = 1 << 20) -> int:
    """0 below ``base`` bytes; each further tier holds sizes four times as large."""
    return max(0, (size // base).bit_length() + 1) // 2


def plan(shards: tuple[Shard, ...], target: int, min_merge: int) -> list[list[Shard]]:
    """Groups of shards of one tier whose sizes sum to ``target`` at most, ``min_merge`` or more in each."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.bytes < target:
            tiers.setdefault(tier(s.bytes), []).append(s)
    groups: list[list[Shard]] = []
    for of_tier in tiers.values():
        group: list[Shard] = []
        size = 0
        for s in sorted(of_tier, key=lambda s: (s.bytes, s.file)):
            if group and size + s.bytes > target:
                groups.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        groups.append(group)
    return [g for g in groups if len(g) >= min_merge]


class ShardStore:
    """A table in ``root``, a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, small_rows: int = 2000, min_merge: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small_rows, self.min_merge = target, small_rows, min_merge
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("_manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self, folder: str, deep: bool = True, before: float | None = None) -> list[Shard]:
        """Files of a folder; with ``before``, those last changed at that time (in milliseconds) or earlier."""
        if not self.fs.exists(self._path(folder)):
            return []
        found, it = [], self.fs.listFiles(self._path(folder), deep)
        prefix = self.fs.makeQualified(self._path("")).toString() + "/"
        while it.hasNext():
            f = it.next()
            if before is not None and f.getModificationTime() > before:
                continue
            found.append(Shard(f.getPath().toString().removeprefix(prefix), f.getLen()))
        return sorted(found, key=lambda s: s.file)

    def versions(self) -> list[int]:
        return sorted(int(s.file[-13:-5]) for s in self._files("_manifest", False) if s.file.endswith(".json") and "/v" in s.file)

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if not found:
            return Manifest(0, None, ())
        version = found[-1] if version is None else version
        lines = self.spark.sparkContext.wholeTextFiles(f"{self.root}/_manifest/v{version:08d}.json").first()[1].splitlines()
        return Manifest(version, json.loads(lines[0])["schema"], tuple(Shard(**json.loads(x)) for x in lines[1:]))

    def _commit(self, old: Manifest, schema: str, shards: list[Shard]) -> Manifest:
        new = Manifest(old.version + 1, schema, tuple(sorted(shards, key=lambda s: s.file)))
        draft = self._path(f"_manifest/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray("\n".join([json.dumps({"schema": schema}), *(json.dumps(asdict(s)) for s in new.shards)]).encode()))
        out.close()
        jvm, options = self.jvm, self.jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(options, 0)  # do not overwrite
        try:
            context.rename(draft, self._path(f"_manifest/v{new.version:08d}.json"), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.version} is there") from e
            raise
        return new

    def append(self, df: DataFrame, attempts: int = 5) -> Manifest:
        """Adds the rows of ``df`` as small shards; the columns must be those of the store."""
        folder = f"data/a-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", self.small_rows).parquet(f"{self.root}/{folder}")
        new = [s for s in self._files(folder) if s.file.endswith(".parquet")]
        return self._replace(set(), new, df.schema, attempts)

    def _replace(self, gone: set[str], new: list[Shard], schema: StructType, attempts: int) -> Manifest:
        """Commits the newest version without the files ``gone`` and with ``new``; a lost race is run again on the version that won it."""
        for k in range(attempts):
            old = self.manifest()
            if old.schema and StructType.fromJson(json.loads(old.schema)).names != schema.names:
                raise ValueError(f"columns are {schema.names}")
            if not gone <= {s.file for s in old.shards}:
                raise Conflict("another compaction has replaced some of the files")
            try:
                return self._commit(old, schema.json(), [*(s for s in old.shards if s.file not in gone), *new])
            except Conflict:
                if k == attempts - 1:
                    raise
                time.sleep(random.uniform(0, 0.05 * 2**k))
        raise AssertionError

    def compact(self, broadcast_files: int = 100_000, attempts: int = 20) -> Manifest:
        """Rewrites every group of `plan`, and then what can be merged on, until no group is left; rows keep their file until the commit.

        A group is a task and a file.  Appends meanwhile do no harm.
        """
        old = self.manifest()
        while groups := plan(old.shards, self.target, self.min_merge):
            folder = f"data/c-{uuid.uuid4().hex}"
            inputs = [(s.file.rsplit("/", 1)[-1], k) for k, g in enumerate(groups) for s in g]
            of = self.spark.createDataFrame(inputs, "file string, group_no int")  # one short row for each file to rewrite
            of = F.broadcast(of) if len(inputs) <= broadcast_files else of
            rows = self._rows([s for g in groups for s in g], old.schema).join(of, "file")
            rows.repartitionById(len(groups), F.col("group_no")).select("row.*").write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone = {s.file for g in groups for s in g}
            new = [s for s in self._files(folder) if s.file.endswith(".parquet")]
            old = self._replace(gone, new, StructType.fromJson(json.loads(old.schema)), attempts)
        return old

    def _rows(self, shards: list[Shard] | tuple[Shard, ...], schema: str) -> DataFrame:
        """(row, file): whole rows and the names of their files."""
        rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s.file}" for s in shards])
        return rows.select(F.struct("*").alias("row"), F.col("_metadata.file_name").alias("file"))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with column ``shard`` (the file's name)."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else StructType()
        name = "shard"
        while name in (f.name.lower() for f in schema):
            name += "_"
        if not m.shards:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(""))
        return self._rows(m.shards, m.schema).select("row.*", F.col("file").alias(name))

    def vacuum(self, keep_versions: int = 1, min_age_s: float = 7 * 86_400) -> int:
        """Removes manifests of versions older than the newest ``keep_versions``, and data files that no kept version names.

        A file younger than ``min_age_s`` stays: an append may have written and not yet committed it.
        """
        versions = self.versions()
        kept = versions[-keep_versions:]
        named = {s.file for v in kept for s in self.manifest(v).shards}
        before = (time.time() - min_age_s) * 1000
        gone = [s.file for s in self._files("data", before=before) if s.file.endswith(".parquet") and s.file not in named]
        for name in [*gone, *(f"_manifest/v{v:08d}.json" for v in versions if v not in kept)]:
            self.fs.delete(self._path(name), False)
        return len(gone)
