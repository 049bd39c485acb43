"""Tables that change by rows: insert, delete by predicate, replace; each change is a new version.

A table is a folder of changes. A change is a folder of rows that came, or of
keys that went, and a marker named by the version's number that says which. The
marker comes last and only if there is none of that number, so a version is
there as a whole or not at all (a file is renamed to it, which fails where one
is), and of two writers that start from one version the second fails and may try
again. Nothing that a reader of an older version
reads is ever rewritten.

A version's rows are those that came up to it, without those whose key went
later: one anti-join by key and number of the change, against the keys alone. No
data are rewritten by a delete. ``compact`` folds a version into one change; it
starts from the version that it read, like any writer.

Cases: a delete of nothing is a version of its own with a count of 0; a null key
can go like any other; rows that share a key go together; an insert of no rows
is allowed; columns are those of the first insert, in any order; readers of a
table without versions get an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, GONE, WHOLE = "rows", "gone", "whole"


class Conflict(RuntimeError):
    """Another writer has made the version that this one would have made."""


@dataclass(frozen=True)
class Change:
    number: int
    kind: str
    folder: str
    count: int


@dataclass
class Versioned:
    """The table under ``path``, whose rows are known by the column ``key``."""

    spark: SparkSession
    path: str
    key: str

    # ------------------------------------------------------------ versions
    def _file(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}")

    def _files(self):
        folder = self._file(".").getParent()
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def changes(self, version: int | None = None) -> list[Change]:
        """The changes that make up a version, the last by default: those since the table was last written whole."""
        fs, folder = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        out: list[Change] = []
        for n in sorted((int(n) for n in names if n.isdigit() and (version is None or int(n) <= version)), reverse=True):
            stream = fs.open(self._file(str(n)))
            try:
                out.insert(0, Change(n, **json.loads(stream.readUTF())))
            finally:
                stream.close()
            if out[0].kind == WHOLE:
                break
        return out

    def version(self) -> int:
        """The last version's number; 0 before the first."""
        found = self.changes()
        return found[-1].number if found else 0

    def _commit(self, base: int, kind: str, folder: str, count: int) -> None:
        """Make version ``base`` + 1, or fail if another writer has."""
        sc, (fs, _) = self.spark.sparkContext, self._files()
        written, marker = self._file(f"new-{uuid.uuid4().hex}"), self._file(str(base + 1))
        stream = fs.create(written, False)
        stream.writeUTF(json.dumps({"kind": kind, "folder": folder, "count": count}))
        stream.close()
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(written, marker, how)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(written, False)
            raise Conflict(f"version {base + 1} exists") from e

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, int]:
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.parquet(f"{self.path}/{folder}").count()

    # ------------------------------------------------------------ reading
    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default."""
        found = self.changes(version)
        came = [c for c in found if c.kind != GONE]
        if not came or (version is not None and found[-1].number != version):
            raise ValueError(f"no version {version} under {self.path}")
        gone = [c for c in found if c.kind == GONE and c.count]
        whole = self._numbered(came)
        if gone:
            last = self._numbered(gone).groupBy(self.key).agg(F.max("__change").alias("__gone")).withColumnRenamed(self.key, "__key")
            whole = whole.join(last, F.col(self.key).eqNullSafe(F.col("__key")) & (F.col("__change") < F.col("__gone")), "left_anti")
        return whole.drop("__change")

    def _numbered(self, changes: list[Change]) -> DataFrame:
        """Rows of several changes with the change's number; one scan for each, planned as one union."""
        out = None
        for c in changes:
            df = self.spark.read.parquet(f"{self.path}/{c.folder}").withColumn("__change", F.lit(c.number))
            out = df if out is None else out.unionByName(df)
        return out

    # ------------------------------------------------------------ changes
    def insert(self, rows: DataFrame) -> int:
        """Add ``rows``; returns how many."""
        base = self.version()
        folder, count = self._write(ROWS, rows)
        self._commit(base, ROWS, folder, count)
        return count

    def delete(self, where: Column | str) -> int:
        """Remove the rows that ``where`` holds of; returns how many.

        Rows that share a key with one of them go too and are counted.
        """
        base = self.version()
        now = self.read(base)
        keys = now.where(where).select(self.key).distinct()
        folder, _ = self._write(GONE, keys)
        went = self.spark.read.parquet(f"{self.path}/{folder}").withColumnRenamed(self.key, "__key")
        count = now.join(went, F.col(self.key).eqNullSafe(F.col("__key")), "left_semi").count()
        self._commit(base, GONE, folder, count)
        return count

    def replace(self, rows: DataFrame) -> int:
        """Make ``rows`` the whole table; returns how many."""
        base = self.version()
        folder, count = self._write(WHOLE, rows)
        self._commit(base, WHOLE, folder, count)
        return count

    def compact(self) -> int:
        """Fold all changes into one; returns the rows there are."""
        return self.replace(self.read())
