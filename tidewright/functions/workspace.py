"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: While a table is written: Spark removes the shuffle files of a statement at its end, and Python workers get few rows at once.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and everything runs in one process (tests), one of this run's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/tidewright-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


class Workspace:
    """Named Parquet tables of one operator call.

    A written table cuts the lineage: when an executor is lost, its tasks read the
    table again instead of computing what stands before it. An operator drops what
    its result does not read; the rest goes when the ``scope`` that the call was
    made in ends, or with the shared folder.
    """

    _scopes: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        if self._scopes:
            self._scopes[-1].append(self)

    @classmethod
    @contextmanager
    def scope(cls):
        """Workspaces made inside are removed at the end: what is read of them has to be written by then."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for work in cls._scopes.pop():
                delete(work.spark, work.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, frame: DataFrame) -> DataFrame:
        """Write the frame and return a reader of what was written; the shuffle files of that go at once."""
        write(frame, self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def once(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in a workspace of its own: computed once, however often it is read."""
    return Workspace(frame.sparkSession, label).keep("rows", frame)


def write(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write Parquet under ``_SETTINGS``, and leave the session's settings as they were."""
    conf = frame.sparkSession.conf
    before = {name: conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        conf.set(name, value)
    try:
        frame.write.mode(mode).parquet(path)
    finally:
        for name, value in before.items():
            conf.set(name, value) if value is not None else conf.unset(name)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
