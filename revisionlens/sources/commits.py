"""Commit records: small files that appear whole or not at all.

A batch first writes its data to a folder of its own, then one record that names
the folder.  Readers only follow records, so a batch that failed or was run
twice leaves data that nothing reads.  Records go through Hadoop's file
interface, in the folder of the table they belong to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def commit(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write the record ``name``; False if it is there already (then nothing changes)."""
    jvm, target = spark._jvm, _path(spark, f"{folder}/{name}")
    fs = target.getFileSystem(_conf(spark))
    if fs.exists(target):
        return False
    fs.mkdirs(_path(spark, folder))
    part = _path(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), _conf(spark))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(target), spark.sparkContext._gateway.new_array(rename, 0))
    except Exception:
        fs.delete(part, False)
        if fs.exists(target):            # another writer of the same batch was faster
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of all records, sorted."""
    path = _path(spark, folder)
    fs = path.getFileSystem(_conf(spark))
    if not fs.exists(path):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if not n.startswith("."))


def text(spark: SparkSession, folder: str, name: str) -> str:
    path = _path(spark, f"{folder}/{name}")
    fs = path.getFileSystem(_conf(spark))
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def folders(spark: SparkSession, folder: str) -> set[str]:
    """The names of a folder's subfolders."""
    path = _path(spark, folder)
    fs = path.getFileSystem(_conf(spark))
    return {s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()} if fs.exists(path) else set()


def delete(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    path.getFileSystem(_conf(spark)).delete(path, True)
