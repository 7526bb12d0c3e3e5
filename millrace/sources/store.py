"""A stored corpus: tables in hash buckets, whose next versions become visible together by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import tidy

#: Buckets of a table; a load rewrites those that its keys fall into.
BUCKETS = 64


class Conflict(Exception):
    """Another load has committed since this one read its snapshot."""


class Folder:
    """What Spark's readers can't do in a shared folder: list, read and write small files, rename without overwriting, delete."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @cached_property
    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Whether the file got its new name; it doesn't where that is taken."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kind, 0)
        try:
            context.rename(self._at(old), self._at(new), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Version:
    """An earlier schema of a table, and the steps from it to the next one and back."""

    schema: str
    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Table:
    """Columns of a table, the one whose hash gives a row's bucket, and its earlier schemas from the first on.

    Files are read by the schema that they were written under and taken up to the present one, step by step; buckets that a load
    rewrites are of the present one from then on. Columns that files lack otherwise are null.
    """

    schema: str
    key: str
    before: tuple[Version, ...] = ()

    @property
    def version(self) -> int:
        return len(self.before) + 1

    def schema_of(self, version: int) -> str:
        return self.schema if version == self.version else self.before[version - 1].schema

    def names(self, version: int) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema_of(version).split(", ")]

    def moved(self, df: DataFrame, old: int, new: int) -> DataFrame:
        """Rows of one version as those of another."""
        for v in range(old, new):
            df = self.before[v - 1].up(df).select(*self.names(v + 1))
        for v in range(old, new, -1):
            df = self.before[v - 2].down(df).select(*self.names(v - 1))
        return df


@dataclass(frozen=True)
class Snapshot:
    """Which run wrote each bucket of each table, under the number of the last load, and the schema versions of runs. 0 is the empty corpus."""

    number: int
    tables: dict[str, dict[int, str]]
    report: dict
    versions: dict[str, dict[str, int]] = field(default_factory=dict)


@dataclass(frozen=True)
class Change:
    """Rows that come in; those stored under their keys, or under the keys of ``touched`` (a column named as the table's key), go.

    With ``touched`` the rows are computed once, as they are written."""

    rows: DataFrame
    touched: DataFrame | None = None


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """Tables under ``folder``: files at ``<table>/_run=<run>/_bucket=<n>``, and for each load a manifest that names the run of every bucket.

    A load writes its runs first and its manifest last, by a rename that fails where the number is taken: until then readers see the
    snapshot before, and of two loads from one snapshot the second raises ``Conflict``. The folder has to be on a file system with such a
    rename (HDFS and local ones have it). What a load that died has left is not named by any manifest; ``vacuum`` deletes it.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int = BUCKETS):
        self.spark, self.tables, self.buckets, self.folder = spark, tables, buckets, Folder(spark, folder)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The last committed snapshot, or the one of a number."""
        number = max(self.numbers(), default=0) if number is None else number
        if number == 0:
            return Snapshot(0, {}, {})
        m = json.loads(self.folder.read(f"manifests/{number:012d}.json"))
        if m["buckets"] != self.buckets:
            raise ValueError(f"the store has {m['buckets']} buckets")
        return Snapshot(number, {t: {int(b): r for b, r in runs.items()} for t, runs in m["tables"].items()}, m["report"], m["versions"])

    def read(self, name: str, at: Snapshot | None = None, buckets: set[int] | None = None, version: int | None = None) -> DataFrame:
        """A table of a snapshot, or some buckets of it, whose files alone are listed; under its present schema or that of another version."""
        table, at = self.tables[name], at or self.snapshot()
        wanted = version or table.version
        paths: dict[int, list[str]] = {}
        for b, r in sorted(at.tables.get(name, {}).items()):
            if buckets is None or b in buckets:
                paths.setdefault(at.versions.get(name, {}).get(r, table.version), []).append(f"{self.folder.path}/{name}/_run={r}/_bucket={b}")
        found = None
        for v, files in sorted(paths.items()):
            rows = self.spark.read.schema(f"{table.schema_of(v)}, _run string, _bucket int").option("basePath", f"{self.folder.path}/{name}").parquet(*files)
            part = table.moved(rows.drop("_run", "_bucket"), v, wanted)
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], table.schema_of(wanted)) if found is None else found

    def lookup(self, name: str, key: str, at: Snapshot | None = None) -> DataFrame:
        """Rows of one key: of one bucket's files, whose rows are sorted by key and have a Bloom filter for it."""
        c = F.col(self.tables[name].key)
        bucket = self.spark.range(1).select(bucket_of(F.lit(key), self.buckets)).first()[0]
        return self.read(name, at, {bucket}).where(c == key)

    def commit(self, base: Snapshot, changes: dict[str, Change], report: dict | Callable[[], dict] | None = None) -> Snapshot:
        """The snapshot after some changes. Only buckets that a changed key falls into are read and written again. A report that
        is a function is asked when the tables are written, so that it can tell what was counted there."""
        run = f"{base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        tables = dict(base.tables)
        for name, change in changes.items():
            tables[name] = self._written(name, base, change, run)
        runs = {t: {r: base.versions.get(t, {}).get(r, self.tables[t].version) for r in set(of.values())} for t, of in tables.items()}
        done = Snapshot(base.number + 1, tables, (report() if callable(report) else report) or {}, runs)
        self.publish(done, run)
        return done

    def _written(self, name: str, base: Snapshot, change: Change, run: str) -> dict[int, str]:
        table = self.tables[name]
        keys = (change.rows if change.touched is None else change.touched).select(table.key).distinct()
        hit = {r[0] for r in keys.select(bucket_of(F.col(table.key), self.buckets)).distinct().collect()}
        old = base.tables.get(name, {})
        kept = {b: r for b, r in old.items() if b not in hit}
        if not hit:
            return kept
        names = table.names(table.version)
        rest = self.read(name, base, hit).join(keys, table.key, "left_anti")
        rows = rest.select(*names).unionByName(change.rows.select(*names)).withColumn("_bucket", bucket_of(F.col(table.key), self.buckets))
        dealt = rows.repartition(len(hit), "_bucket").sortWithinPartitions("_bucket", table.key)
        writer = dealt.write.partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{table.key}", "true").option("compression", "zstd")
        with tidy(self.spark):
            writer.parquet(f"{self.folder.path}/{name}/_run={run}")
        new = [int(n.partition("=")[2]) for n in self.folder.names(f"{name}/_run={run}") if n.startswith("_bucket=")]
        return kept | dict.fromkeys(new, run)  # a bucket without rows has no files

    def publish(self, new: Snapshot, run: str) -> None:
        """Make a snapshot the last one, or raise where its number is taken."""
        text = json.dumps({"number": new.number, "buckets": self.buckets, "tables": new.tables, "report": new.report, "versions": new.versions}, default=str)
        self.folder.write(f"manifests/.{run}", text)
        if not self.folder.rename(f"manifests/.{run}", f"manifests/{new.number:012d}.json"):
            self.folder.delete(f"manifests/.{run}")
            raise Conflict(f"snapshot {new.number} is taken")

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` snapshots, and delete runs that none of these names. Not while a load is under way."""
        numbers = self.numbers()
        if not numbers:
            return
        last = [self.snapshot(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self.folder.delete(f"manifests/{n:012d}.json")
        for name in self.tables:
            used = {r for s in last for r in s.tables.get(name, {}).values()}
            for folder in self.folder.names(name):
                if folder.startswith("_run=") and folder[5:] not in used:
                    self.folder.delete(f"{name}/{folder}")

