"""Appends that happen once: a log of commits says which folders of rows count.

Every append writes a folder of its own under `rows/` and then takes the next number in `log/` by renaming a small file to it, which fails
where the number is taken. So a writer that dies before its rename leaves a folder that nobody reads, one that dies after it has
committed, and of two writers at one number the slower takes out the keys that came first and tries the next. The file system has
to refuse a rename onto an existing file, as HDFS does. The driver reads one short line per commit, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sinks


class Ledger:
    """A table of answers under `path`, each key once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[dict]:
        """(folder, batch) of all commits in order."""
        if not self.files.exists(self._path("log")):
            return []
        lines = self.spark.read.text(f"{self.path}/log/[0-9]*").selectExpr("_metadata.file_name as name", "value").collect()
        return [json.loads(r.value) for r in sorted(lines, key=lambda r: r.name)]

    def read(self, commits: list[dict] | None = None) -> DataFrame | None:
        """The rows of all (or of some) commits; None where there is no commit."""
        folders = [f"{self.path}/rows/{c['folder']}" for c in (self.commits() if commits is None else commits)]
        return self.spark.read.parquet(*folders) if folders else None

    def commit(self, number: int, entry: dict) -> bool:
        """Whether the entry took its number in the log."""
        draft, place = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{number:012d}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(place), none)
            return True
        except Exception as e:  # the number is taken, or the file system is at fault
            self.files.delete(draft, False)
            if self.files.exists(place):
                return False
            raise e

    def append(self, df: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], batch: str | None = None) -> int:
        """Run `work` (which keeps the key's columns) once on the rows whose key has no answer yet; returns how many rows it added.

        A `batch` that has been committed adds nothing, whatever it holds now. Repeated keys are worked on once; rows with a null in
        the key are left out, as they can't be found again."""
        rows, folder, known = df.dropna(subset=key).dropDuplicates(key), None, 0
        while True:
            log = self.commits()
            if batch is not None and any(c["batch"] == batch for c in log):
                self._drop(folder)
                return 0
            done = self.read(log[known:])
            if folder is None or done is not None:
                mine = work(sinks.pending(rows, done, key) if done is not None else rows) if folder is None else sinks.pending(self._rows(folder), done, key)
                last, folder = folder, uuid.uuid4().hex
                mine.write.parquet(f"{self.path}/rows/{folder}")
                self._drop(last)
            known, n = len(log), self._rows(folder).count()
            if not n and batch is None:
                self._drop(folder)
                return 0
            if self.commit(known, {"folder": folder, "batch": batch}):
                return n

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/{folder}")

    def _drop(self, folder: str | None) -> None:
        if folder:
            self.files.delete(self._path(f"rows/{folder}"), True)
