"""Versioned tables: immutable Parquet files, and one log of JSON entries for all tables of a folder.

A table's folder holds its data files. An entry of ``_log/`` lists what one
commit changed: of any number of tables, the schema, the key and the files added
and dropped. So a commit of several tables is one file, and there or not there as
a whole. An entry is written under another name and published by an operation
that fails if its number is taken (a hard link on local disks, else a rename
without overwriting); a writer that comes second looks whether its tables have
changed, and conflicts or takes the next number. A writer that dies leaves files
that nothing refers to. Every EVERY entries the whole state is written too, and
readers start from there; entries before the last but one such state are deleted.

All access goes through Hadoop's file systems. Several writers at once need one
whose rename is atomic, as HDFS; on plain object stores there may be one writer.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisFailure, ConflictFailure
from ..plans.planner import SEQ
from ..types import SPARK


#: Entries between two states of the log.
EVERY = 20


@dataclass(frozen=True)
class Version:
    """One state of a table."""

    number: int
    columns: tuple[tuple[str, str], ...]  # name, type
    key: str | None = None
    files: tuple[str, ...] = field(default=())  # below the table's folder
    next_seq: int = 0
    streams: tuple[tuple[str, int], ...] = ()  # streams that write here, and the last batch of each

    @property
    def kinds(self) -> dict[str, str]:
        return dict(self.columns)

    def schema(self) -> T.StructType:
        fields = [T.StructField(n, SPARK[k], n != self.key, {"pk": True} if n == self.key else {}) for n, k in self.columns]
        return T.StructType([*fields, T.StructField(SEQ, T.LongType(), False)])


class Store:
    """Tables in one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _listed(self) -> tuple[list[int], list[int]]:
        """Numbers of the log's entries, and of its states, in order."""
        folder = self._path("_log")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        of = lambda end: sorted(int(n.removesuffix(end)) for n in names if n.endswith(end) and n.removesuffix(end).isdigit())
        return of(".json"), of(".state")

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"_log/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self, number: int | None = None) -> tuple[int, dict[str, Version]]:
        """The number of the log's last entry (or of the given one, if it is still there), and all tables as of it."""
        for _ in range(5):
            entries, states = self._listed()
            last = (entries or states or [-1])[-1] if number is None else number
            start = max((n for n in states if n <= last), default=-1)
            todo = [n for n in entries if start < n <= last]
            if todo != list(range(start + 1, last + 1)):
                if number is not None:
                    raise AnalysisFailure(f"the log no longer goes back to entry {number}")
                continue  # entries were deleted between two listings
            try:
                tables = {t: self._version(v) for t, v in (self._load(f"{start:020d}.state") if start >= 0 else {}).items()}
                for n in todo:
                    for table, raw in self._load(f"{n:020d}.json").items():
                        drop = set(raw.pop("drop"))
                        before = tables[table].files if table in tables else ()
                        tables[table] = self._version(raw | {"files": [*(f for f in before if f not in drop), *raw.pop("add")]})
                return last, tables
            except Exception as e:
                if "FileNotFoundException" not in str(e):
                    raise
        raise ConflictFailure("the log keeps changing")

    @staticmethod
    def _version(raw: dict) -> Version:
        pairs = lambda name: tuple(map(tuple, raw[name]))
        return Version(raw["number"], pairs("columns"), raw["key"], tuple(raw["files"]), raw["next_seq"], pairs("streams"))

    def tables(self) -> list[str]:
        return sorted(self.state()[1])

    def latest(self, table: str) -> Version | None:
        return self.state()[1].get(table)

    def version(self, table: str) -> Version:
        found = self.latest(table)
        if found is None:
            raise AnalysisFailure(f"table {table} not found")
        return found

    def _publish(self, name: str, content: dict) -> bool:
        """Make a whole file of the log; False if it is there already."""
        own, path = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{name}")
        stream = self._fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        uri = self._fs.makeQualified(path).toUri()
        try:
            if uri.getScheme() == "file":
                os.link(unquote(self._fs.makeQualified(own).toUri().getPath()), unquote(uri.getPath()))
            else:
                options = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark.sparkContext._jsc.hadoopConfiguration())
                kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                kinds[0] = options
                context.rename(self._fs.makeQualified(own), self._fs.makeQualified(path), kinds)
        except Exception:
            if self._fs.exists(path):
                return False
            raise
        finally:
            self._fs.delete(own, False)
        return True

    def commit(self, changes: dict[str, tuple[Version, int]]) -> dict[str, Version]:
        """All changes in one entry: by table its new version and the number of that which it follows (-1: none).

        ConflictFailure, and no change, if one of the tables isn't at that version any more.
        """
        while True:
            last, tables = self.state()
            for table, (_, base) in changes.items():
                if (tables[table].number if table in tables else -1) != base:
                    raise ConflictFailure(f"table {table} has changed since version {base}")
            out = {t: replace(v, number=last + 1) for t, (v, _) in changes.items()}
            entry = {}
            for table, version in out.items():
                before = tables[table].files if table in tables else ()
                raw, old, new = asdict(version), set(before), set(version.files)
                del raw["files"]
                entry[table] = raw | {"add": [f for f in version.files if f not in old], "drop": [f for f in before if f not in new]}
            if self._publish(f"{last + 1:020d}.json", entry):
                break
        if (last + 1) % EVERY == 0:
            self._publish(f"{last + 1:020d}.state", {t: asdict(v) for t, v in (tables | out).items()})
            entries, states = self._listed()
            for n in entries:
                if len(states) > 1 and n <= states[-2]:
                    self._fs.delete(self._path(f"_log/{n:020d}.json"), False)
            for n in states[:-2]:
                self._fs.delete(self._path(f"_log/{n:020d}.state"), False)
        return out

    def read(self, table: str, version: Version, files: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of a version (or of some of its files) with the hidden order column."""
        names = version.files if files is None else files
        if not names:
            return self.spark.createDataFrame([], version.schema())
        reader = self.spark.read.schema(version.schema()).option("recursiveFileLookup", "false")
        return reader.parquet(*[f"{self.root}/{table}/{n}" for n in names])

    def write(self, table: str, df: DataFrame, version: Version) -> tuple[str, ...]:
        """New data files with the rows of df, sorted by key within each so that key lookups can skip row groups."""
        names = [n for n, _ in version.columns] + [SEQ]
        out = df.select(*[F.col(f"`{n}`") for n in names])
        if version.key:
            out = out.sortWithinPartitions(F.col(f"`{version.key}`"))
        folder = f"data/{uuid.uuid4().hex}"
        out.write.parquet(f"{self.root}/{table}/{folder}")
        found = self._fs.listStatus(self._path(f"{table}/{folder}"))
        return tuple(sorted(f"{folder}/{s.getPath().getName()}" for s in found if s.getPath().getName().endswith(".parquet")))

    def files_with(self, table: str, version: Version, condition) -> tuple[str, ...]:
        """The files that hold a row for which condition is true."""
        if not version.files:
            return ()
        hit = self.read(table, version).where(condition).select(F.col("_metadata.file_path").alias("f")).distinct()
        ends = {"/".join(r.f.split("/")[-3:]) for r in hit.collect()}  # names of files, not rows
        return tuple(n for n in version.files if n in ends)

    def remove_unused(self, table: str) -> int:
        """Delete data folders that the newest version doesn't use; only while nobody writes or reads older versions."""
        version = self.version(table)
        used = {n.split("/")[1] for n in version.files}
        folder, gone = self._path(f"{table}/data"), 0
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in used:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone
