"""Tables that actions change: versioned snapshots, change sets merged by key, and commits that cannot overwrite each other.

A version is a manifest, a small text that names a base and the change sets since.  An action reads a version, works out the
rows that it changes (whole new rows, or keys that go), writes them as a change set, and commits the next version by giving
its manifest the next number, which fails if that number is taken.  It then looks at the new state and tries again, so
neither of two writers loses the other's changes, and a rule such as "only what is still open" holds when it is committed.

Reading merges: of each key the row of the last change set that has it.  After some change sets a new base is written.
Old versions stay readable.  Keys are not null; a change set has each key once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.operators.lifecycle import Conflict

#: Change sets that a read merges at most; the next change writes a base.
MOST_CHANGES = 8
GONE, CHANGED = "_gone", "_changed"


@dataclass(frozen=True)
class Manifest:
    version: int
    base: str
    changes: tuple[tuple[int, str], ...]


class Snapshots:
    """A table under a path of a file system that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._files = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.path).toUri(), conf)
        self._fs = self._hadoop.Path(self.path).getFileSystem(conf)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/versions/{version:010d}.json"

    def version(self) -> int:
        """The last version; -1 where there is none."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=-1)

    def manifest(self, version: int | None = None) -> Manifest:
        at = self.version() if version is None else version
        said = json.loads("".join(r.value for r in self.spark.read.text(self._manifest_path(at)).collect()))
        return Manifest(at, said["base"], tuple((v, p) for v, p in said["changes"]))

    def _commit(self, manifest: Manifest) -> None:
        """Publishes a version, or raises Conflict where it exists."""
        ready = self._hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(ready, False)
        out.write(json.dumps({"base": manifest.base, "changes": manifest.changes}).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._files.rename(ready, self._hadoop.Path(self._manifest_path(manifest.version)), none)
        except Py4JJavaError as e:
            self._fs.delete(ready, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {manifest.version} of {self.path} exists") from None
            raise

    def _write(self, rows: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def create(self, rows: DataFrame) -> None:
        """The first version."""
        self._commit(Manifest(0, self._write(rows.withColumn(CHANGED, F.lit(0).cast("long")), "base"), ()))

    def _merged(self, m: Manifest) -> DataFrame:
        base = self.spark.read.parquet(m.base)
        if not m.changes:
            return base
        schema = T.StructType([*base.schema.fields, T.StructField(GONE, T.BooleanType())])
        every = base.withColumn(GONE, F.lit(False))
        for version, path in m.changes:
            every = every.unionByName(self.spark.read.schema(schema).parquet(path).withColumn(CHANGED, F.lit(version).cast("long")))
        last = every.groupBy(self.key).agg(F.max_by(F.struct(*every.columns), CHANGED).alias("row")).select("row.*")
        return last.where(~F.col(GONE)).drop(GONE)

    def read(self, version: int | None = None, changed: bool = False) -> DataFrame:
        """The rows of a version; with changed, also the version that each row is of, as _changed."""
        rows = self._merged(self.manifest(version))
        return rows if changed else rows.drop(CHANGED)

    def change(self, rows_of: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Commits the rows that rows_of makes of the state (all columns; with a true column _gone, keys to remove), and returns the version.

        Where another writer was first, rows_of sees the new state; after so many tries, Conflict.
        """
        for last in range(tries):
            m = self.manifest()
            now = self.read(m.version)
            new = rows_of(now)
            new = new if GONE in new.columns else new.withColumn(GONE, F.lit(False))
            path = self._write(new.select(*now.columns, F.coalesce(GONE, F.lit(False)).alias(GONE)), "changes")
            version = m.version + 1
            following = Manifest(version, m.base, (*m.changes, (version, path)))
            try:
                if len(following.changes) > MOST_CHANGES:
                    following = Manifest(version, self._write(self._merged(following), "base"), ())
                self._commit(following)
                return version
            except Conflict:
                if last + 1 == tries:
                    raise
        raise Conflict("no tries")
