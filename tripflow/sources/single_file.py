"""One CSV file out of many tasks: parts without headers, written in parallel and joined in their order.

No task writes or copies the whole. On HDFS the parts become one file by ``concat``, which moves blocks in
the name node only. On a mounted file system every part has its place in the file, known from the sizes of
those before it, and tasks copy the parts there side by side. Object stores can do neither; they refuse,
and ``export_csv`` writes a folder of files instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.functions.times import ISO_MICROS_PATTERN

#: Bytes that a task holds while it copies.
COPIED = 8 << 20


def export_one_csv(df: DataFrame, out: str, order: list[str | Column], pattern: str = ISO_MICROS_PATTERN) -> None:
    """Write ``df`` as the one CSV file ``out``, with a header line and the rows in ``order``.

    Rows are sorted by range over all tasks. Names in the header are quoted where they need it. What is at
    ``out`` is replaced at the end, so that a failed run leaves it; parts lie in ``<out>.parts`` till then.
    """
    spark, parts = df.sparkSession, f"{out.rstrip('/')}.parts"
    names = ",".join('"' + c.replace('"', '\\"') + '"' if set(c) & set(',"\n\r') else c for c in df.columns)
    options = {"timestampFormat": pattern, "timestampNTZFormat": pattern, "compression": "none"}
    df.orderBy(*order).write.mode("overwrite").options(header="false", **options).csv(f"{parts}/rows")
    spark.createDataFrame([(names,)], "line string").coalesce(1).write.mode("overwrite").text(f"{parts}/head")
    join_parts(spark, [f"{parts}/head", f"{parts}/rows"], out)
    _files(spark, parts)[0].delete(_path(spark, parts), True)


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, folder: str) -> tuple[JavaObject, list[tuple[str, int]]]:
    """The file system, and (path, bytes) of a folder's part files in the order of their names."""
    path = _path(spark, folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in system.listStatus(path) if f.isFile() and f.getPath().getName().startswith("part-")]
    return system, sorted((f.getPath().toString(), f.getLen()) for f in found)


def join_parts(spark: SparkSession, folders: list[str], out: str) -> None:
    """One file of all part files of the folders, one folder after the other."""
    target = _path(spark, out)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [p for folder in folders for p in _files(spark, folder)[1] if p[1]]
    if system.getScheme() == "hdfs":
        first, *rest = [_path(spark, name) for name, _ in parts]
        listed = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(rest))
        for i, part in enumerate(rest):
            listed[i] = part
        if rest:
            system.concat(first, listed)
        system.delete(target, True)
        system.rename(first, target)
    elif system.getScheme() == "file":
        # Not through Hadoop, which would keep check sums of what it has written beside the file.
        whole = _local(spark, f"{out}.joined")
        with open(whole, "wb"):
            pass
        rows, at = [], 0
        for name, size in parts:
            rows.append((_local(spark, name), whole, at, size))
            at += size
        _copy(spark, rows)
        if os.path.getsize(whole) != at:
            raise RuntimeError(f"{out} has not got all of its {at} bytes; is its folder mounted on all executors?")
        system.delete(target, True)
        os.replace(whole, _local(spark, out))
    else:
        raise ValueError(f"a store of kind {system.getScheme()!r} cannot join files; use export_csv")


def _local(spark: SparkSession, path: str) -> str:
    return _path(spark, path).toUri().getPath()


def _copy(spark: SparkSession, rows: list[tuple[str, str, int, int]]) -> None:
    """Copy each part to its place; a part that is copied again writes the same bytes there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, target, at, size in batch[["name", "target", "at", "size"]].itertuples(index=False):
                with open(name, "rb") as part, open(target, "r+b") as whole:
                    whole.seek(at)
                    while data := part.read(COPIED):
                        whole.write(data)
            yield batch[["size"]]

    if rows:
        places = spark.createDataFrame(rows, "name string, target string, at long, size long").repartition(len(rows))
        copied = places.mapInPandas(run, "size long").agg(F.sum("size")).first()[0]
        if copied != sum(r[3] for r in rows):
            raise RuntimeError("some parts were not copied")
