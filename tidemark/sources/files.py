"""Small files in any store that Spark reaches, by Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of ``path``, and the path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = at(spark, path)
    return bool(store.exists(found))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is no such file."""
    store, found = at(spark, path)
    if not store.exists(found):
        return None
    stream = store.open(found)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then put it in its place."""
    store, new = at(spark, path + ".new")
    stream = store.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    move(spark, path + ".new", path)


def move(spark: SparkSession, path: str, to: str) -> None:
    store, old = at(spark, path)
    _, new = at(spark, to)
    store.delete(new, True)
    if not store.rename(old, new):
        raise OSError(f"{path} could not be moved to {to}")


def only_part(spark: SparkSession, folder: str) -> str:
    """The path of the single data file that Spark wrote into a folder."""
    store, found = at(spark, folder)
    parts = [str(s.getPath()) for s in store.listStatus(found) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise OSError(f"{folder} holds {len(parts)} data files, not one")
    return parts[0]
