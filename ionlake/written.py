"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine, as in tests) gets a folder of its own for as long as Python runs;
    any other session is refused, as executors do not see each other's local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="ionlake-shared-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


class Written:
    """Tables written to the shared folder to cut lineage.

    ``drop`` removes one that is no longer read. Those that a returned DataFrame still reads stay until Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        if not self.count:
            atexit.register(self._sweep)
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._written_path)

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        kept = {df._written_path for df in tables}
        for k in range(1, self.count + 1):
            if f"{self.base}/{k}" not in kept:
                self._delete(f"{self.base}/{k}")  # one that is gone already does no harm

    def _sweep(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before Python
            self._delete(self.base)
