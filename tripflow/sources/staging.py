"""Intermediate tables in the shared folder of the cluster.

A table written there cuts lineage and survives the loss of any executor. The folder is the one
the session names in ``spark.checkpoint.dir``. Only a session that runs in one process and names
none gets a temporary folder of its own. ``clear`` removes what an application has written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER_SETTING = "spark.checkpoint.dir"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[tuple[str, ...], str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(_FOLDER_SETTING, None)
    if folder:
        return folder
    # ``local-cluster`` has executors of its own and is no exception.
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {_FOLDER_SETTING} to a folder that all executors can reach")
    key = ("folder", spark.conf.get("spark.app.id"))
    if key not in _written:
        _written[key] = tempfile.mkdtemp(prefix="tripflow-")
    return _written[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, in the application's part of the shared folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tripflow/{spark.conf.get('spark.app.id', 'app')}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written with ``settle`` and ``written_once``.

    For the end of a job: frames that read those tables are of no use afterwards. An application
    that dies before leaves its folder, named by its id, to the shared folder's retention rule.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _written if k[0] == spark.conf.get("spark.app.id")]:
        del _written[key]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block; what it was before holds again after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write a frame that several passes will read, and return it read back.

    The shuffle files of the write go once it has ended: nothing reads them again, and a chain of
    written tables would otherwise hold those of all its steps until the driver collects garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _CLEANUP_SETTING, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(settled: DataFrame) -> None:
    """Remove a table that ``settle`` returned, once nothing reads it any more.

    Only folders that this application has written are touched.
    """
    spark = settled.sparkSession
    mine = f"/tripflow/{spark.conf.get('spark.app.id', 'app')}/"
    for folder in {name.rpartition("/")[0] for name in settled.inputFiles() if mine in name}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_once(
    spark: SparkSession, name: str, source: str, write: Callable[[str], None]
) -> str:
    """Path of an input derived from ``source``, written on first use in this application."""
    key = (spark.conf.get("spark.app.id"), source, name)
    if key not in _written:
        path = new_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]
