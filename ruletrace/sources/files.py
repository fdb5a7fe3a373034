"""Files as a store sees them: existence, small texts, and changes that readers see as a whole."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it in its ``path`` columns."""
    fs, target = file_system(spark, path)
    return fs.makeQualified(target).toString()


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order."""
    fs, target = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def empty_files(spark: SparkSession, path: str, below: bool = False) -> list[str]:
    """Files without any byte at or under a path."""
    fs, target = file_system(spark, path)
    found, each = [], fs.listFiles(target, below)
    while each.hasNext():
        status = each.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append(status.getPath().toString())
    return found


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text in a file's place in one step: a reader sees the old file or the new one."""
    beside = f"{path}.{uuid4().hex}"
    fs, target = file_system(spark, beside)
    stream = fs.create(target)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(target, jvm.org.apache.hadoop.fs.Path(path), how)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, old = file_system(spark, source)
    if not fs.rename(old, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)
