"""Replacing several partitions of a Parquet store as one step.

New rows are written to a hidden folder first; a run that dies there has changed nothing. Then a
journal names the partitions to replace and to remove, and only with the journal in place are folders
moved. Moving is safe to repeat, so whoever opens the store next ends what a dead run began: readers
and writers see the old rows or, after :func:`recover`, all of the new ones.

One writer at a time; a reader beside a running commit may see some partitions new and others old.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGE, _JOURNAL, _DRAFT = "_staging-", "_commit-", "_draft-"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, root: str) -> list[str]:
    fs, path = _files(spark, root), _path(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def partitions(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Partition folders below ``root``, ``depth`` levels down, relative to it."""
    found = [""]
    for _ in range(depth):
        found = [f"{p}/{c}".lstrip("/") for p in found for c in _children(spark, f"{root}/{p}".rstrip("/"))
                 if "=" in c and c[0] not in "_."]
    return found


def _move(spark: SparkSession, root: str, name: str, journal: str) -> None:
    """Carry a journal out; steps that were done are passed over."""
    fs = _files(spark, root)
    for line in journal.splitlines():
        step, part = line.split(" ", 1)
        staged, place = _path(spark, root, _STAGE + name, part), _path(spark, root, part)
        if step == "replace" and fs.exists(staged):
            fs.delete(place, True)
            fs.mkdirs(place.getParent())
            if not fs.rename(staged, place):
                raise OSError(f"cannot move {staged} to {place}")
        elif step == "remove":
            fs.delete(place, True)
    fs.delete(_path(spark, root, _JOURNAL + name), False)
    fs.delete(_path(spark, root, _STAGE + name), True)


def recover(spark: SparkSession, root: str) -> None:
    """End commits whose journal is still there."""
    for child in sorted(_children(spark, root)):
        if child.startswith(_JOURNAL):
            stream = _files(spark, root).open(_path(spark, root, child))
            try:
                journal = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            _move(spark, root, child[len(_JOURNAL):], journal)


def replace_partitions(df: DataFrame, root: str, keys: list[str], stale=lambda part: False) -> None:
    """Put the rows of ``df`` in the place of the partitions (by ``keys``) that they fall in, and remove
    those other partitions for which ``stale`` holds. One job, whatever the number of partitions; ``df``
    may read the store itself."""
    spark = df.sparkSession
    recover(spark, root)
    name = uuid.uuid4().hex
    stage = f"{root}/{_STAGE}{name}"
    fs = _files(spark, root)
    try:
        df.write.partitionBy(*keys).parquet(stage)
    except BaseException:
        fs.delete(_path(spark, stage), True)
        raise
    new = partitions(spark, stage, len(keys))
    old = set(partitions(spark, root, len(keys))) - set(new)
    steps = [f"replace {p}" for p in new] + [f"remove {p}" for p in sorted(old) if stale(p)]
    journal = "".join(f"{s}\n" for s in steps)
    draft = _path(spark, root, _DRAFT + name)
    out = fs.create(draft)
    out.write(bytearray(journal.encode()))
    out.close()
    if not fs.rename(draft, _path(spark, root, _JOURNAL + name)):
        raise OSError(f"cannot write a journal in {root}")
    _move(spark, root, name, journal)
