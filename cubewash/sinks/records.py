"""Small JSON records under a name that is given once (S-07).

A record is first written whole under a temporary name and then gets its public
name, which fails if that is taken. So a record is absent or complete, and of any
number of writers that race for a name one wins. On a local file system the public
name is a hard link, elsewhere a rename that the file system refuses if the name is
taken (HDFS); stores that can do neither need a lock of their own.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object, JVM view) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def publish(spark: SparkSession, path: str, record: dict) -> bool:
    """Give ``record`` the name ``path``; False if the name is taken."""
    fs, p, jvm = file_system(spark, path)
    fs.mkdirs(p.getParent())
    folder = fs.resolvePath(p.getParent())
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    p = jvm.org.apache.hadoop.fs.Path(folder, p.getName())
    temporary = jvm.org.apache.hadoop.fs.Path(folder, f".{p.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    try:
        out.write(json.dumps(record).encode())
        out.close()
        if fs.getScheme() == "file":
            try:
                os.link(temporary.toUri().getPath(), p.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(p) and bool(fs.rename(temporary, p))
    finally:
        fs.delete(temporary, False)


def read(spark: SparkSession, path: str) -> dict | None:
    """The record of a name; None if there is none, or what is there is no record."""
    fs, p, jvm = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        record = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return record if isinstance(record, dict) else None


def set_aside(spark: SparkSession, path: str) -> bool:
    """Free a name whose content is of no use; False if another writer was first."""
    fs, p, jvm = file_system(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.stale")
    try:
        return bool(fs.rename(p, aside))
    except Exception:  # py4j: the file is gone
        if fs.exists(p):
            raise
        return False


def names(spark: SparkSession, folder: str) -> list[str]:
    """Public names in a folder, sorted; none where there is no folder."""
    fs, p, _ = file_system(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in found if not n.startswith("."))
