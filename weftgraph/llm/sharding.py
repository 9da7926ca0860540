"""A sharded table with size-tiered compaction and versioned manifests.

Arrivals are appended as runs: folders of small immutable Parquet shards.  Runs of similar size
form a tier; a tier of enough runs is merged into one run of target-sized files.  A manifest lists
a version's runs; versions are committed one after another, each by one rename, and readers see a
whole version or the one before it.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import shared_dir

TARGET_BYTES = 128 << 20
#: Runs of one tier that are merged together, at least; a tier spans this factor of sizes.
FAN = 4
LEAST_RUN_BYTES = 1 << 20
ARRIVALS = 16
#: Seconds after which a claim without a manifest counts as left behind: renaming a finished manifest takes less than one.
PATIENCE = 300.0
#: Seconds for which vacuum leaves what a version listed that was the newest one then: readers may have it open.
GRACE = 24 * 3600.0
#: Seconds after which a writer that registered a run and neither committed nor gave it up counts as dead.
ABANDONED = 7 * 24 * 3600.0
#: How often a commit is tried anew on the newest version.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """Runs and manifests under a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN) -> None:
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # manifests

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest: schema (JSON or None) and runs, each with its path, bytes, and the versions' numbers that made it."""
        version = self.version() if version is None else version
        if version == 0:
            return {"schema": None, "runs": []}
        rows = self.spark.read.text(f"{self.root}/manifests/v{version:08d}.json", wholetext=True).first()
        return json.loads(rows[0])

    def commit(self, base: int, schema: str | None, runs: list[dict], patience: float = PATIENCE) -> int:
        """Makes runs the version after base: claims its number, which one writer can, and renames the whole manifest into place.

        A claim without a manifest after `patience` seconds is that of a writer that died: it is
        taken over by deleting it, which one writer can, and claiming anew.
        """
        at = f"{self.root}/manifests/v{base + 1:08d}"
        claim, done = self._path(f"{at}.claim"), self._path(f"{at}.json")
        if self._fs.exists(done):
            raise Conflict(f"version {base + 1} is committed")
        temp = self._path(f"{at}.{uuid.uuid4().hex}.tmp")  # the whole manifest stands before anything is claimed
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps({"schema": schema, "runs": runs}).encode()))
        out.close()
        if not self._claimed(claim, patience):
            self._fs.delete(temp, False)
            raise Conflict(f"version {base + 1} is claimed by another writer")
        if self._fs.exists(done) or not self._fs.rename(temp, done):
            self._fs.delete(temp, False)
            raise Conflict(f"version {base + 1} could not be renamed into place")
        return base + 1

    def _claimed(self, claim, patience: float) -> bool:
        """Whether this writer holds the claim, made now or taken over from a writer that died."""
        for left in (2, 1, 0):
            try:
                self._fs.create(claim, False).close()
                return True
            except Py4JJavaError:
                if not self._fs.exists(claim):  # taken over just now, or a folder that cannot be written
                    if not left:
                        raise
                    continue
            age = time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000
            if age < patience or not self._fs.delete(claim, False):
                return False
        return False

    def _bytes(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._path(path)).getLength())

    # data

    @contextmanager
    def _run(self) -> Iterator[str]:
        """A path for a new run, registered before anything is written there and until it is committed or given up: vacuum spares it."""
        name = uuid.uuid4().hex
        mark = self._path(f"{self.root}/writing/{name}")
        self._fs.create(mark, False).close()
        try:
            yield f"{self.root}/runs/{name}"
        finally:
            self._fs.delete(mark, False)

    def append(self, df: DataFrame) -> int:
        """One arrival as one run; returns the new version."""
        with self._run() as path:
            df.write.option("compression", "zstd").parquet(path)
            return self._added(df, [{"path": path, "bytes": self._bytes(path)}])

    def _added(self, df: DataFrame, runs: list[dict]) -> int:
        """The version with more runs: of writers that meet, each in turn adds to the newest version."""
        for i in range(TRIES):
            base, old = self.version(), self.manifest()
            try:
                return self.commit(base, old["schema"] or df.schema.json(), [*old["runs"], *({**r, "made": base + 1} for r in runs)])
            except Conflict:
                time.sleep(0.05 * (i + 1))
        raise Conflict(f"{TRIES} tries met other writers")

    def append_all(self, df: DataFrame, arrival: Column) -> int:
        """Many arrivals written by one job, each a run; they are committed together."""
        name = "arrival_" + uuid.uuid4().hex[:8]
        with self._run() as path:
            df.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(path)
            runs = [{"path": str(s.getPath().toString()), "bytes": self._bytes(str(s.getPath().toString()))} for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
            return self._added(df, sorted(runs, key=lambda r: r["path"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest)."""
        return self._rows(m := self.manifest(version), m["runs"])

    def _rows(self, manifest: dict, runs: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        if manifest["schema"] is None:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*[r["path"] for r in runs]) if runs else self.spark.createDataFrame([], schema)

    # compaction

    def tier(self, size: int) -> int:
        """Runs whose sizes differ by less than the fan share a tier; all of less than LEAST_RUN_BYTES are in the first."""
        return max(0, math.floor(math.log(max(1, size) / LEAST_RUN_BYTES, self.fan)) + 1)

    def compact(self) -> int:
        """Merges the runs of each full tier into target-sized files until no tier is full; returns the version."""
        while True:
            base, now = self.version(), self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in now["runs"]:
                tiers.setdefault(self.tier(r["bytes"]), []).append(r)
            full = sorted(t for t, runs in tiers.items() if len(runs) >= self.fan)
            if not full:
                return base
            merged = tiers[full[0]]
            with self._run() as path:
                self._merge(now, merged, path)
                self._replaced({r["path"] for r in merged}, {"path": path, "bytes": self._bytes(path)})

    def _replaced(self, gone: set[str], run: dict) -> int:
        """The version with a merged run in place of those it holds; if another writer has merged one of them, the run is dropped."""
        for i in range(TRIES):
            base, now = self.version(), self.manifest()
            if not gone <= {r["path"] for r in now["runs"]}:
                return base
            try:
                return self.commit(base, now["schema"], [*[r for r in now["runs"] if r["path"] not in gone], {**run, "made": base + 1}])
            except Conflict:
                time.sleep(0.05 * (i + 1))
        raise Conflict(f"{TRIES} tries met other writers")

    def _merge(self, manifest: dict, runs: list[dict], path: str) -> None:
        """Rewrites runs without a shuffle: Spark packs whole small shards into tasks of target size, a task writes a file."""
        settings = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            self._rows(manifest, runs).write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def vacuum(self, keep: int = 1, grace: float = GRACE, abandoned: float = ABANDONED) -> int:
        """Deletes runs that nobody can need; returns how many paths went.

        Kept are the runs of the newest `keep` versions, those of versions that were the newest one
        at any time in the last `grace` seconds, and those that a writer has registered and not yet committed, unless it did so
        more than `abandoned` seconds ago.  Registrations are read before manifests, so that a run
        that is committed meanwhile is seen in one of both.
        """
        now = time.time()
        age = lambda s: now - s.getModificationTime() / 1000
        marks = self._path(f"{self.root}/writing")
        writing = {s.getPath().getName(): age(s) for s in (self._fs.listStatus(marks) if self._fs.exists(marks) else [])}
        runs = self._path(f"{self.root}/runs")
        there = list(self._fs.listStatus(runs)) if self._fs.exists(runs) else []  # what comes later is not looked at
        newest, used = self.version(), set()
        for v in range(newest, 0, -1):
            after = age(self._fs.getFileStatus(self._path(f"{self.root}/manifests/v{v + 1:08d}.json"))) if v < newest else 0.0
            if v <= newest - keep and after > grace:
                break  # the versions before it ended earlier still
            used |= {self._local(r["path"]) for r in self.manifest(v)["runs"]}
        gone = 0
        for top in there:
            if writing.get(top.getPath().getName(), math.inf) <= abandoned:
                continue
            inner = [s.getPath().toString() for s in self._fs.listStatus(top.getPath()) if s.isDirectory()]
            for p in inner or [top.getPath().toString()]:
                if self._local(p) not in used:
                    gone += bool(self._fs.delete(self._path(p), True))
        return gone

    @staticmethod
    def _local(path: str) -> str:
        """A run's path below the store's folder, however the file system writes the rest."""
        return path.rstrip("/").rpartition("/runs/")[2]


def sharded(df: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """df's rows through a store: appended as arrivals, compacted, and read back from the newest manifest.

    Every row comes back once, whatever its nulls, ties or repetitions; an empty df gives an empty
    result; all columns are kept, whatever their names.
    """
    store = ShardStore(df.sparkSession, root or shared_dir(df.sparkSession), target_bytes)
    key = df.columns[0]
    store.append_all(df, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(arrivals)))
    store.compact()
    return store.read()


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the compacted store returns it: doc_id, n_bytes and the text's SHA-256."""
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


ORACLE = """
SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
