"""Path tests on whatever file system a path lives on."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class EmptySourceError(ValueError):
    """No input was found where a source was asked to read."""


def _resolved(spark: SparkSession, path: str):
    """A path and the file system it lives on."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files or folders that match a glob, in order of name; empty where there are none."""
    path, file_system = _resolved(spark, pattern)
    found = file_system.globStatus(path)
    return sorted(status.getPath().toString() for status in (found or []))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a plain path exists; brackets and stars in it are ordinary characters."""
    found, file_system = _resolved(spark, path)
    return file_system.exists(found)


def create_empty(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there stays."""
    found, file_system = _resolved(spark, path)
    file_system.createNewFile(found)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file where there is none; false where there is one already, also if another
    writer was first. It is there as a whole or not at all: a draft is written, then given its name.
    On a local file system a second name can be given only where it is free; elsewhere a file system
    must refuse to rename to a name that is taken, as HDFS does."""
    jvm = spark.sparkContext._jvm
    found, file_system = _resolved(spark, path)
    file_system.mkdirs(found.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(found.getParent(), f".{uuid.uuid4().hex}")
    stream = file_system.create(draft, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    try:
        if file_system.makeQualified(found).toUri().getScheme() == "file":
            local = [jvm.java.io.File(place.toUri().getPath()).toPath() for place in (found, draft)]
            jvm.java.nio.file.Files.createLink(*local)
            return True
        return not file_system.exists(found) and file_system.rename(draft, found)
    except Py4JJavaError:
        if file_system.exists(found):
            return False
        raise
    finally:
        file_system.delete(draft, False)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, read without a Spark job."""
    found, file_system = _resolved(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(file_system.open(found), "UTF-8"))
    try:
        return "\n".join(iter(reader.readLine, None))
    finally:
        reader.close()


def qualified_path(spark: SparkSession, path: str) -> str:
    """A path with the file system it stands for."""
    found, file_system = _resolved(spark, path)
    return file_system.makeQualified(found).toString()


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Make a folder that its file system removes when the application ends."""
    found, file_system = _resolved(spark, path)
    if not file_system.exists(found):
        file_system.mkdirs(found)
        file_system.deleteOnExit(found)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more; what takes long needs the room meanwhile."""
    found, file_system = _resolved(spark, path)
    file_system.delete(found, True)


def replace_folder(spark: SparkSession, draft: str, path: str) -> None:
    """Give a folder that is done the name it is read by, in place of what had that name."""
    place, file_system = _resolved(spark, path)
    source, _ = _resolved(spark, draft)
    file_system.delete(place, True)
    if not file_system.rename(source, place):
        raise OSError(f"{draft} could not be renamed to {path}")


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of the first file of a path that has one, read without a Spark job."""
    jvm = spark.sparkContext._jvm
    place, file_system = _resolved(spark, path)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(file_system.getConf())
    listed = sorted((status for status in file_system.listStatus(place)), key=lambda s: s.getPath().getName())
    for status in listed:
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if status.isDirectory():
            line = first_line(spark, status.getPath().toString())
        else:
            stream = file_system.open(status.getPath())
            codec = codecs.getCodec(status.getPath())
            opened = codec.createInputStream(stream) if codec else stream
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8"))
            try:
                line = reader.readLine()
            finally:
                reader.close()
        if line is not None:
            return line
    return None
