"""Sharding by size-tiered compaction.

A store is a folder.  ``append`` writes an arrival as small immutable shards, and
``append_parts`` many arrivals in one pass over their table.  ``compact`` groups the runs of
a size tier (powers of ``FANOUT``) and, where a tier has ``FANOUT`` runs or more, rewrites
them as one run of files of about the target size; shards are read in parallel and nothing
is shuffled.  The live shards are those of the newest manifest, a JSON file that also holds
the store's schema, the union of all arrivals'.

A manifest is written aside and then given its version's name, which fails if another
writer has taken it: by a hard link on local file systems and by a rename elsewhere.  So of
two writers one wins and the other starts again; a writer that dies leaves files that no
manifest names, which ``vacuum`` removes once they are old.  Object stores that overwrite on
rename are refused.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, table

FANOUT = 4
TARGET_BYTES = 256 << 20
SMALLEST = 1 << 20  #: runs up to this size are the lowest tier
ORPHAN_HOURS = 24  #: files that no manifest names are removed at this age
OVERWRITING = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "swift")  #: file systems whose rename isn't exclusive


@dataclass(frozen=True)
class Run:
    """Shards written together; immutable."""

    path: str
    files: tuple[str, ...]
    bytes: int
    rows: int

    @property
    def tier(self) -> int:
        return max(0, math.ceil(math.log(max(self.bytes, 1) / SMALLEST, FANOUT)))


class Conflict(RuntimeError):
    """Another writer committed this version."""


def union_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """Columns of both, all nullable.  A name with two types, or two names that differ in case alone, is refused."""
    fields = {f.name: f.dataType for f in old.fields} if old else {}
    for f in new.fields:
        if fields.setdefault(f.name, f.dataType).simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} was {fields[f.name].simpleString()} and is {f.dataType.simpleString()} now")
    if len({n.lower() for n in fields}) < len(fields):
        raise ValueError(f"columns differ in case alone: {sorted(fields)}")
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


class ShardStore:
    """Versioned sets of shards below ``path``; all files go through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme in OVERWRITING:
            raise ValueError(f"{self._scheme} has no exclusive rename to commit by")

    # -- manifests ----------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, list[Run], T.StructType | None]:
        """(version, runs, schema) of a version, by default the newest; version 0 is an empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, [], None
        held = json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/v{version:08d}.json").first()[0])
        runs = [Run(r["path"], tuple(r["files"]), r["bytes"], r["rows"]) for r in held["runs"]]
        return version, runs, T.StructType.fromJson(held["schema"])

    def runs(self, version: int | None = None) -> list[Run]:
        return self._manifest(version)[1]

    def schema(self, version: int | None = None) -> T.StructType | None:
        return self._manifest(version)[2]

    def commit(self, version: int, runs: list[Run], schema: T.StructType) -> None:
        """Make ``runs`` the manifest of ``version``, or raise Conflict."""
        folder = f"{self.path}/manifests"
        self._fs.mkdirs(self._path(folder))
        aside, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/v{version:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema.jsonValue(), "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        if not self._take(aside, final):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} exists")

    def _take(self, aside, final) -> bool:
        """Give the file ``aside`` the name ``final`` unless that exists."""
        if self._scheme != "file":
            return self._fs.rename(aside, final)
        local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(local(final), local(aside))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        self._fs.delete(aside, False)
        return True

    def _change(self, make) -> None:
        """Commit ``make(runs, schema)`` on top of the newest version, again after each conflict; None ends it."""
        while True:
            version, runs, schema = self._manifest()
            changed = make(runs, schema)
            if changed is None:
                return
            try:
                return self.commit(version + 1, *changed)
            except Conflict:
                continue

    # -- writing ------------------------------------------------------------------------

    def _run(self, path: str, rows: int) -> Run:
        status = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")]
        return Run(path, tuple(sorted(s.getPath().getName() for s in status)), sum(s.getLen() for s in status), rows)

    def _write(self, df: DataFrame) -> Run:
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._run(path, self.spark.read.schema(df.schema).parquet(path).count())

    def _add(self, run: Run, schema: T.StructType) -> Run:
        self._change(lambda runs, old: ([*runs, run], union_schema(old, schema)))
        return run

    def append(self, arrival: DataFrame) -> Run:
        """Write an arrival as it is partitioned and commit it; nothing that exists is touched.

        New columns are added to the store's schema and are null in older rows; an arrival
        whose columns clash with it is refused.
        """
        union_schema(self.schema(), arrival.schema)
        return self._add(self._write(arrival), arrival.schema)

    def append_parts(self, df: DataFrame, part: Column, n: int, after=lambda: None) -> list[Run]:
        """One pass over ``df`` writes ``n`` arrivals, part 0 to n - 1; each is then committed like
        an arrival of its own, and ``after`` is called."""
        union_schema(self.schema(), df.schema)
        base, name = f"{self.path}/runs/{uuid.uuid4().hex}", "_part"
        while name in [c.lower() for c in df.columns]:
            name += "_"
        df.withColumn(name, part.cast("int")).write.partitionBy(name).parquet(base)
        counts = dict(self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])).parquet(base).groupBy(name).count().collect())
        out = []
        for i in range(n):
            if i in counts:
                out.append(self._add(self._run(f"{base}/{name}={i}", counts[i]), df.schema))
                after()
        return out

    def _merge(self, runs: list[Run], schema: T.StructType) -> Run:
        rows = self._rows(runs, schema)
        files = max(1, math.ceil(sum(r.bytes for r in runs) / self.target))
        parts = rows.rdd.getNumPartitions()
        return self._write(rows.coalesce(files) if files <= parts else rows.repartition(files))

    def compact(self) -> int:
        """Merge until no tier has ``fanout`` runs; returns the number of merges."""
        merges = 0
        while True:
            _, live, schema = self._manifest()
            tiers: dict[int, list[Run]] = {}
            for r in live:
                tiers.setdefault(r.tier, []).append(r)
            full = min((t for t, rs in tiers.items() if len(rs) >= self.fanout), default=None)
            if full is None:
                return merges
            new, gone = self._merge(tiers[full], schema), {r.path for r in tiers[full]}
            done = []

            def swap(runs: list[Run], held: T.StructType):
                if not gone <= {r.path for r in runs}:  # another writer merged them
                    return None
                done.append(1)
                return [*[r for r in runs if r.path not in gone], new], held

            self._change(swap)
            if done:
                merges += 1
            else:
                self._fs.delete(self._path(new.path), True)

    def vacuum(self, keep: int = 2, orphan_hours: float = ORPHAN_HOURS) -> None:
        """Delete all but the newest ``keep`` manifests, the runs that only older ones name, and
        what no manifest names once it is ``orphan_hours`` old (it may be a writer's that still runs)."""
        versions = self.versions()
        held = {v: {r.path for r in self.runs(v)} for v in versions}
        live = set().union(*[held[v] for v in versions[-keep:]])
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:08d}.json"), False)
        for path in set().union(*held.values()) - live:
            self._fs.delete(self._path(path), True)
        old = (time.time() - orphan_hours * 3600) * 1000
        self._drop_old(f"{self.path}/runs", lambda folder: any(p == folder or p.startswith(f"{folder}/") for p in live), old)
        self._drop_old(f"{self.path}/manifests", lambda file: file.rsplit("/", 1)[1].startswith("v"), old)

    def _drop_old(self, folder: str, named, before: float) -> None:
        if self._fs.exists(self._path(folder)):
            for s in self._fs.listStatus(self._path(folder)):
                if s.getModificationTime() < before and not named(f"{folder}/{s.getPath().getName()}"):
                    self._fs.delete(s.getPath(), True)

    # -- reading ------------------------------------------------------------------------

    def _rows(self, runs: list[Run], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{r.path}/{f}" for r in runs for f in r.files])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All live rows of a version in the store's columns; none if the store was never written."""
        _, runs, schema = self._manifest(version)
        return self._rows(runs, schema) if runs else None


def ingest(spark: SparkSession, docs: DataFrame, part: Column, n: int, path: str, **options) -> ShardStore:
    """Append ``n`` arrivals, the parts of ``docs``, one after another in a single pass over it;
    after each, tiers are compacted and all but the last two versions dropped.

    Rows are kept exactly as they come: nulls, repeated rows and empty parts included.
    """
    store = ShardStore(spark, path, **options)

    def tidy() -> None:
        store.compact()
        store.vacuum()

    if not store.append_parts(docs, part, n, tidy):
        store.append(docs)  # no rows: a run without any keeps the columns
    return store


def op6_tiered_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight arrivals; where each of them lies in the end."""
    docs = table(spark, sf_dir, "documents")
    store = ingest(spark, docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)), 8, shared_path(spark, "shards"))
    lies = r"runs/([0-9a-f]+)(?:/_part_*=\d+)?/part-(\d+)"
    place, part = (F.regexp_extract(F.input_file_name(), lies, i) for i in (1, 2))
    return store.read().select("doc_id", "n_chars", "source", F.xxhash64("text").alias("text_hash"), place.alias("run_id"), part.cast("int").alias("shard"), F.lit(store.versions()[-1]).alias("version"))
