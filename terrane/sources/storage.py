"""Small files in the shared folder through the session's Hadoop file system: manifests and listings."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files right under path, none if it does not exist."""
    fs, p, _ = file_system(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = file_system(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Make a file that must not exist yet, whole or not at all: of two writers of one path the second fails.

    The text goes to a hidden file first, which is then given its name: by a hard link on a local or mounted disk, by a
    rename that never overwrites elsewhere. Both are atomic, the latter on HDFS and the like; an object store without
    atomic renames needs a lock outside.
    """
    fs, p, jvm = file_system(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda x: unquote(urlparse(fs.makeQualified(x).toString()).path)
            os.link(local(hidden), local(p))
        else:
            never = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            how[0] = never
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(hidden, p, how)
    finally:
        fs.delete(hidden, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = file_system(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def newest_json(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(highest number, content of the highest readable one) of the files <number>.json in a folder; (0, None) if there is none.

    A file that is cut short or not JSON is passed over, but its number stays taken.
    """
    paths = sorted(f for f in list_files(spark, folder) if f.endswith(".json") and f.rpartition("/")[2][:-5].isdigit())
    for f in reversed(paths):
        try:
            content = json.loads(read_text(spark, f))
        except ValueError:
            continue
        if isinstance(content, dict):
            return int(paths[-1].rpartition("/")[2][:-5]), content
    return (int(paths[-1].rpartition("/")[2][:-5]) if paths else 0), None
