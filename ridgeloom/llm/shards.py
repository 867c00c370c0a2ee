"""Sharding: small immutable shards as data arrive, size-tiered compaction, a versioned manifest committed atomically.

An append writes its rows as small Parquet shards in a folder of their own, a run, and commits a manifest that names
it beside all earlier runs. Compaction groups runs of similar size (tiers grow by FANOUT), and merges every tier that
has RUN runs or more into one run of files of about ``target_bytes``: partitions of the scan are put together without a
shuffle, and each is written as one file. So a row is written again once for each tier. What a merge will give
follows from the manifest, before anything is written. A manifest is a small table written aside and then renamed to
its version; the rename fails if another writer took that version, and the commit is then made again on top of it.
Readers keep the version they opened until ``vacuum``.

All work on rows is DataFrame code. The driver sees one row for each run, of which there are few in each tier however
many rows and files they hold; the files in them are listed by Spark's reader alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT, RUN = 4, 4
TARGET_BYTES, SHARD_ROWS = 128 << 20, 4096
MANIFEST = "run string, files bigint, bytes bigint, rows bigint, tier int"


class ShardStore:
    """A folder of runs and manifests under ``root``, a URI on a file system shared by all executors."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target_bytes = spark, root.rstrip("/"), target_bytes

    # -- versions ---------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        folder = self._path("manifest")
        if not self._files().exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self._files().listStatus(folder) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, files, bytes, rows and tier of every run of a version (the latest by default)."""
        known = self.versions()
        if version is None and not known:
            return self.spark.range(0).selectExpr(*[f"cast(null as {kind}) {name}" for name, kind in map(str.split, MANIFEST.split(", "))])
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{known[-1] if version is None else version:08d}")

    def _commit(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Writes the changed latest manifest as the next version; starts over if that version is taken."""
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._files().mkdirs(self._path("manifest"))
        for _ in range(tries):
            version = max(self.versions(), default=0) + 1
            aside = f"aside-{uuid.uuid4().hex}"
            change(self.manifest()).select("run", "files", "bytes", "rows", "tier").coalesce(1).write.parquet(f"{self.root}/{aside}")
            try:
                context.rename(self._path(aside), self._path(f"manifest/v{version:08d}"), plain)
                return version
            except Py4JJavaError as taken:
                self._files().delete(self._path(aside), True)
                if "FileAlreadyExists" not in str(taken.java_exception):
                    raise
        raise RuntimeError(f"no version could be committed in {tries} tries")

    # -- writing ----------------------------------------------------------------------------------

    def _written(self, rows: DataFrame, shard_rows: int = 0) -> DataFrame:
        """Writes a run; its row of the manifest, none where there was nothing to write."""
        run = uuid.uuid4().hex
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/data/{run}")
        names = [s.getPath().getName() for s in self._files().listStatus(self._path(f"data/{run}")) if s.getPath().getName().startswith("part-")]
        size = self._files().getContentSummary(self._path(f"data/{run}")).getLength()
        n = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{run}").count()
        tier = int(math.log(max(size, 1), FANOUT))
        return self.spark.range(1 if n else 0).selectExpr(f"'{run}' run", f"bigint({len(names)}) files", f"bigint({size}) bytes", f"bigint({n}) rows", f"{tier} tier")

    def append(self, arrivals: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Adds the rows as a run of shards of ``shard_rows`` at most; returns the version. No rows: no run, a version."""
        added = self._written(arrivals, shard_rows)
        return self._commit(lambda now: now.unionByName(added))

    def compact(self) -> int:
        """Merges each tier with RUN runs or more, and a run whose shards are twice as many as its bytes need.

        Returns the latest version. A merged run may make the next tier full, which is merged by the next call; a loop
        ends when the version stays the same, as each merge lowers the number of runs or at least halves their files.
        """
        tiers: dict[int, list] = {}
        for row in self.manifest().collect():
            tiers.setdefault(row["tier"], []).append(row)
        for _, runs in sorted(tiers.items()):
            files = max(1, -(-sum(r["bytes"] for r in runs) // self.target_bytes))
            if len(runs) < RUN:
                runs = [r for r in runs if r["files"] >= 2 * max(1, -(-r["bytes"] // self.target_bytes))]
                files = max(1, -(-sum(r["bytes"] for r in runs) // self.target_bytes))
            if not runs:
                continue
            merged = [r["run"] for r in runs]
            added = self._written(self._rows(merged).coalesce(files))
            # A run that another writer merged meanwhile is gone already: its rows must not count twice.
            self._commit(lambda latest, merged=merged, added=added: self._replaced(latest, merged, added))
        return max(self.versions(), default=0)

    @staticmethod
    def _replaced(latest: DataFrame, merged: list[str], added: DataFrame) -> DataFrame:
        if latest.where(F.col("run").isin(merged)).count() != len(merged):
            raise RuntimeError("another compaction has merged these runs")
        return latest.where(~F.col("run").isin(merged)).unionByName(added)

    def vacuum(self) -> None:
        """Deletes what the latest version does not name, and earlier manifests. Not while others read or write."""
        known = self.versions()
        live = {r["run"] for r in self.manifest().select("run").collect()}
        fs = self._files()
        for status in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if status.getPath().getName() not in live:
                fs.delete(status.getPath(), True)
        for version in known[:-1]:
            fs.delete(self._path(f"manifest/v{version:08d}"), True)

    # -- reading ----------------------------------------------------------------------------------

    def _rows(self, runs: list[str]) -> DataFrame:
        folders = [f"{self.root}/data/{run}" for run in runs]
        return self.spark.read.schema(self.spark.read.parquet(folders[0]).schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None where it has no runs."""
        runs = [r["run"] for r in self.manifest(version).select("run").collect()]
        return self._rows(runs) if runs else None


def dealt(rows: DataFrame, arrivals: int) -> list[DataFrame]:
    """The rows as so many arrivals, by a hash of all their columns: each row is in exactly one of them."""
    turn = F.pmod(F.xxhash64(*rows.columns), F.lit(arrivals))
    return [rows.where(turn == k) for k in range(arrivals)]


def round_trip(arrivals: Iterable[DataFrame], root: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The arrivals appended one after another as small shards, compacted until nothing more merges after every RUN of
    them and at the end, and read back by the manifest.

    Values may be null, texts empty or long, rows repeated: all return as they are, as often as they occur. Empty
    tables return empty. Column names are the tables' own.
    """
    store, last = None, None
    for k, rows in enumerate(arrivals, 1):
        store, last = store or ShardStore(rows.sparkSession, root, target_bytes), rows
        store.append(rows)
        if k % RUN == 0:
            _settled(store)
    if store is None:
        raise ValueError("no arrivals")
    _settled(store)
    found = store.read()
    return last.limit(0) if found is None else found


def _settled(store: ShardStore) -> None:
    """Compacts until the version stays; nobody else reads the store meanwhile."""
    version, before = max(store.versions()), -1
    while version != before:
        before, version = version, store.compact()
        store.vacuum()


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
