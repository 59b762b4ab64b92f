"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

An arrival is written once as a run of small Parquet files.  A run's tier is the power of FAN that its
size is of BASE_BYTES; where a tier has FAN runs, they are merged into one of files of about TARGET_BYTES: read in order and
written by as many tasks as files, without a shuffle.

The state is a list of runs in a manifest file.  A change is committed against the version that it was made from: the next
version is written aside and renamed to its number, which fails if that number is there already.  Then the writer reads the newer version and
applies its change to that: an arrival is added to the newer list, and a merge takes its own inputs out of it, or is given up where
another writer has merged one of them already.  So no commit undoes another, a reader sees one version whole, and a writer that dies
leaves the last version in force.  This rests on a rename that fails where the target exists, as HDFS has it (on a local file system a
hard link does); an object store without one needs conditional writes behind its Hadoop file system.

vacuum() deletes what no kept version names: versions and runs that are older than the given age, so that readers of a version of less age and
writers that have not committed yet keep their files.

All columns and rows stay as they are (nulls, empty and repeated ones too); an empty arrival adds no run, and a store without runs
reads as an empty table of the store's schema.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import delete, fresh_dir

FAN = 4
BASE_BYTES = 4 << 20
TARGET_BYTES = 128 << 20
ARRIVALS = 16
#: Versions and files of less age than this stay for readers and unfinished writers.
RETENTION_SECONDS = 24 * 3600.0
#: Times a writer tries again on a newer version.
ATTEMPTS = 100


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int

    @property
    def tier(self) -> int:
        return 0 if self.bytes <= BASE_BYTES else 1 + int(math.log(self.bytes / BASE_BYTES, FAN))


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    """retention: seconds that replaced versions and their runs stay after a merge; None leaves that to vacuum()."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, retention: float | None = None):
        self.spark, self.folder, self.schema, self.retention = spark, folder, schema, retention
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(folder).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        where = self._path("manifests")
        if not self._fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def last(self) -> int:
        """The number of the last version, 0 before the first."""
        return (self.versions() or [0])[-1]

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version, the last one by default."""
        version = self.last() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path("manifests", f"{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, base: int, runs: list[Run]) -> int:
        """Writes the version after `base` whole or not at all; raises Conflict where it is there already."""
        version = base + 1
        aside, final = self._path("manifests", f"{uuid.uuid4().hex}.part"), self._path("manifests", f"{version:08d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode())
        finally:
            out.close()
        try:
            self._publish(aside, final)
        except Exception as e:
            self._fs.delete(aside, False)
            if not self._fs.exists(final):
                raise
            raise Conflict(version) from e
        return version

    def _publish(self, aside, final) -> None:
        """Gives a file its final name; fails where that is taken."""
        if self._fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), final.toUri().getPath())  # a local rename would replace the target
            self._fs.delete(aside, False)
            return
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(aside, final, options)

    def change(self, edit: Callable[[list[Run]], list[Run] | None]) -> int | None:
        """Commits edit(runs) of the last version, on a newer one again where another writer was first; None where edit gives up."""
        for _ in range(ATTEMPTS):
            base = self.last()
            runs = edit(self.runs(base))
            if runs is None:
                return None
            try:
                return self.commit(base, runs)
            except Conflict:
                continue
        raise Conflict(f"no commit in {ATTEMPTS} attempts")

    def _run(self, path: str) -> Run:
        files = [f.getLen() for f in self._fs.listStatus(self._hadoop.Path(path)) if f.getPath().getName().endswith(".parquet")]
        return Run(path, sum(files), len(files))

    def adopt(self, path: str) -> Run | None:
        """Commits a folder of Parquet files under data/ as an arrival."""
        new = self._run(path)
        if not new.files:
            return None
        self.change(lambda runs: [*runs, new])
        return new

    def append(self, arrival: DataFrame) -> Run | None:
        """Writes an arrival as a run and commits it."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        arrival.write.parquet(path)
        return self.adopt(path)

    def append_each(self, arrivals: DataFrame, column: str, merge: bool = True) -> None:
        """Writes each value of `column` (which is not stored) as an arrival of its own, in one job, and commits them one after another
        in the order of their names; where that fills a tier it is merged before the next comes."""
        where = f"{self.folder}/data/{uuid.uuid4().hex}"
        arrivals.write.partitionBy(column).parquet(where)
        for path in sorted(f.getPath().toString() for f in self._fs.listStatus(self._hadoop.Path(where)) if f.isDirectory()):
            self.adopt(path)
            if merge:
                self.compact()

    def read(self, version: int | None = None) -> DataFrame:
        runs = self.runs(version)
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[r.path for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def _merge(self, runs: list[Run]) -> Run:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        files = max(1, -(-sum(r.bytes for r in runs) // TARGET_BYTES))
        self.spark.read.schema(self.schema).parquet(*[r.path for r in runs]).coalesce(files).write.parquet(path)
        return self._run(path)

    def compact(self) -> int:
        """Merges until no tier has FAN runs; each merge is one version.  Returns the last version."""
        while True:
            tiers: dict[int, list[Run]] = {}
            for r in self.runs():
                tiers.setdefault(r.tier, []).append(r)
            full = [t for t, own in sorted(tiers.items()) if len(own) >= FAN]
            if not full:
                return self.last()
            gone = tiers[full[0]][:FAN]
            merged = self._merge(gone)

            def replace(runs: list[Run], gone: list[Run] = gone, merged: Run = merged) -> list[Run] | None:
                return [r for r in runs if r not in gone] + [merged] if set(gone) <= set(runs) else None

            if self.change(replace) is None:
                delete(self.spark, merged.path)  # another writer has merged one of them
            elif self.retention is not None:
                self._drop_versions(self.retention)

    def vacuum(self, older: float = RETENTION_SECONDS) -> None:
        """Deletes versions that were replaced more than `older` seconds ago with the runs that only they name, and the folders of
        writers that lost or died, which no version has named for that long."""
        self._drop_versions(older)
        self._drop_orphans(older)

    def _drop_versions(self, older: float) -> None:
        limit = (time.time() - older) * 1000
        have = self.versions()
        born = [self._fs.getFileStatus(self._path("manifests", f"{v:08d}.json")).getModificationTime() for v in have]
        gone = [v for v, after in zip(have, born[1:], strict=False) if after <= limit]
        named = {v: {r.path for r in self.runs(v)} for v in have}
        used = {p for v in have if v not in gone for p in named[v]}
        for path in {p for v in gone for p in named[v]} - used:
            delete(self.spark, path)
        for v in gone:
            self._fs.delete(self._path("manifests", f"{v:08d}.json"), False)

    def _drop_orphans(self, older: float) -> None:
        limit = (time.time() - older) * 1000
        local = lambda path: self._hadoop.Path(str(path)).toUri().getPath()
        where = self._path("data")
        folders = [f for f in (self._fs.listStatus(where) if self._fs.exists(where) else []) if f.getModificationTime() <= limit]
        named = {local(r.path) for v in self.versions() for r in self.runs(v)}  # read after the listing: what has been named since is in it
        for folder in folders:
            path = folder.getPath().toString()
            inside = [path, *(f.getPath().toString() for f in self._fs.listStatus(folder.getPath()) if f.isDirectory())]
            if not named.intersection(map(local, inside)):
                delete(self.spark, path)


def arrivals_of(docs: DataFrame, column: str, n: int = ARRIVALS) -> DataFrame:
    """docs as n arrivals by doc_id, numbered in a new column; a null doc_id arrives with the first."""
    return docs.withColumn(column, F.coalesce(F.pmod("doc_id", F.lit(n)), F.lit(0)).cast("int"))


def compacted(docs: DataFrame) -> ShardStore:
    """A store of docs that came in ARRIVALS arrivals one after another, compacted as they came.  Nobody else knows the store, so
    what is merged goes at once."""
    store = ShardStore(docs.sparkSession, fresh_dir(docs.sparkSession, "store"), docs.schema, retention=0.0)
    column = "arrival"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    store.append_each(arrivals_of(docs, column), column)
    return store


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as the last version has them: doc_id, lang, source, n_chars, n_bytes and text_md5."""
    rows = compacted(spark.read.parquet(f"{sf_dir}/documents.parquet")).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP5_SQL = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"
