"""Tables that are replaced as a whole: versions in folders of their own, and a pointer that is written last.

``<path>/versions/<name>`` holds a version, ``<path>/pointers/<number>`` names one.  A reader takes the pointer with the
highest number that is complete, so it sees the old table until the new one is whole, and goes on reading it
afterwards, as old versions are removed later, by ``collect_versions``.  A writer that fails leaves a version that no
pointer names.  Only creating a file that isn't there has to be atomic, so any Hadoop file system will do.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of the entries of a folder; none where there is no folder."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(target)]


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the complete pointers, latest first."""
    found = []
    for name, _ in _names(spark, f"{path}/pointers"):
        if name.isdigit():
            fs, target = _fs(spark, f"{path}/pointers/{name}")
            stream = fs.open(target)
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                found.append((int(name), text.strip()))
    return sorted(found, reverse=True)


def publish(spark: SparkSession, path: str, version: str) -> int:
    """Make a written version the current one; of several writers at once each gets a number of its own, the last one counts."""
    number = max((int(n) for n, _ in _names(spark, f"{path}/pointers") if n.isdigit()), default=0) + 1
    while True:
        fs, target = _fs(spark, f"{path}/pointers/{number:012d}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            number += 1
            continue
        try:
            out.write(bytearray(f"{version}\n".encode()))
        finally:
            out.close()
        return number


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version of the table at ``path`` and publish it; the version's name.

    ``df`` may read the table that it replaces.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/versions/{version}")
    publish(df.sparkSession, path, version)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The published version of the table at ``path``, None where there is none."""
    pointers = _pointers(spark, path)
    return pointers[0][1] if pointers else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as it was published last; the frame stays on that version."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published version under {path}")
    return spark.read.parquet(f"{path}/versions/{version}")


def collect_versions(spark: SparkSession, path: str, keep: int = 2, spare_seconds: float = 86_400) -> list[str]:
    """Remove versions that none of the last ``keep`` pointers names; what changed in the last ``spare_seconds`` may still be in
    the making or in use and stays.  Returns what was removed."""
    pointers = _pointers(spark, path)
    kept = {version for _, version in pointers[:keep]}
    limit = (time.time() - spare_seconds) * 1000
    removed = []
    for name, changed in _names(spark, f"{path}/versions"):
        if name not in kept and changed <= limit:
            fs, target = _fs(spark, f"{path}/versions/{name}")
            fs.delete(target, True)
            removed.append(name)
    for number, version in pointers[keep:]:
        if version in removed:
            fs, target = _fs(spark, f"{path}/pointers/{number:012d}")
            fs.delete(target, False)
    return sorted(removed)
