"""Folders that driver and executors share, for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []
_MADE: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (tests, a notebook on one machine) a temporary folder is made; it goes when
    the process ends. A cluster without the setting is an error, as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder for one run of an operator; its name is unique, so that reruns never meet.

    Results read from it, so it stays until release(), or the end of the driver's process.
    """
    folder = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(release)
    _MADE.append(hadoop(spark, folder))
    return folder


def release() -> None:
    """Deletes the work folders of this process; results that weren't stored elsewhere go with them."""
    while _MADE:
        fs, path = _MADE.pop()
        try:
            fs.delete(path, True)
        except Exception:  # the JVM has ended, or the store can't be reached: what is left is the folder's owner's
            return


def hadoop(spark: SparkSession, uri: str):
    """(file system, path) by Hadoop's own API, for the driver's few files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
