"""Small files on any file system that Spark knows: read and written whole, on the driver."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.workspace import delete, exists


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _draft(spark: SparkSession, path: str, text: str):
    system, draft = _system(spark, f"{path}.{uuid.uuid4().hex[:12]}.draft")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    return system, draft


def _renamed(spark: SparkSession, draft, place, replace: bool) -> None:
    """In one step of the file system: over what is there, or raising where something is."""
    fs = spark._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, int(replace))
    if replace:
        how[0] = kind.OVERWRITE
    fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and renamed over it: a reader sees the old file or the new one, whole."""
    system, draft = _draft(spark, path, text)
    try:
        _renamed(spark, draft, _system(spark, path)[1], True)
    finally:
        system.delete(draft, False)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A whole new file, or False where there is one: of several writers one succeeds.

    A local file is linked to its name, which fails if the name is taken; elsewhere the file system's
    rename without overwriting does the same.
    """
    system, place = _system(spark, path)
    _, draft = _draft(spark, path, text)
    try:
        if (place.toUri().getScheme() or system.getUri().getScheme()) == "file":
            files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.io.File
            files.createLink(paths(place.toUri().getPath()).toPath(), paths(draft.toUri().getPath()).toPath())
        else:
            _renamed(spark, draft, place, False)
        return True
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" in str(problem.java_exception.getClass().getName()):
            return False
        raise
    finally:
        system.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    if not exists(spark, folder):
        return []
    system, place = _system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place))


def as_json(value) -> str:
    """Dates and times as ISO text."""
    return json.dumps(value, indent=1, sort_keys=True, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x))


def write_json(spark: SparkSession, path: str, value) -> None:
    """Metadata of a run or a selection."""
    write_text(spark, path, as_json(value))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_csv(frame: DataFrame, folder: str, digits: int | None = None, one_file: bool = True) -> None:
    """A result as CSV with a header, floats rounded; in one file, which is for small results."""
    if digits is not None:
        frame = frame.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in frame.dtypes])
    (frame.coalesce(1) if one_file else frame).write.mode("overwrite").csv(folder, header=True)


__all__ = ["as_json", "create_text", "delete", "exists", "listing", "read_json", "read_text", "write_csv", "write_json", "write_text"]
