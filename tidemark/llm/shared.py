"""What several operators need of the cluster: shared scratch tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a Java regular expression and as plain text.
SPACE_RX = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

#: A group with more than one row in so many is joined by broadcast; at most this many groups can be.
HOT_SHARE = 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only on one machine (tests) and where that is unset, a
    temporary folder is chosen and recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


#: Scratch paths handed out and not removed yet.
_SCRATCH: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back.

    This cuts the lineage, fixes values that depend on task order, and survives the loss of executors. Results read
    such tables until they are written themselves; ``clear`` then deletes them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, wherever it is stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def marked() -> int:
    """A mark for ``clear``: scratch paths handed out from now on come after it."""
    return len(_SCRATCH)


def clear(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the scratch tables made since a mark, once the results that read them are written; ``keep`` stays."""
    for path in _SCRATCH[since:]:
        if path != keep:
            remove(spark, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once: lambda variables are never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has such a column already (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, parts: bool = False) -> DataFrame:
    """Inner join of ``rows`` with one row per group, where a group may hold a third of all rows.

    ``size`` is the group's number of rows. With ``parts`` a group has a row for each of its parts and ``size`` is the
    part's; all parts of a group are joined the same way. Groups of over 1/1000 of all rows number under 1000, whatever the
    input's size, so these few are broadcast; all other groups are small enough for a shuffle join. ``rows`` is read
    twice, so it should be a settled table.
    """
    wholes = groups.groupBy(key).agg(F.sum(size).alias(size)) if parts else groups
    total = wholes.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(max(total, HOT_SHARE))
    if parts:
        keys = wholes.filter(is_hot).select(key)
        hot, rest = groups.join(F.broadcast(keys), key, "left_semi"), groups.join(F.broadcast(keys), key, "left_anti")
    else:
        hot, rest = groups.filter(is_hot), groups.filter(~is_hot)
        keys = hot.select(key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(keys), key, "left_anti").join(rest, key))


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` (settled) with a table of unique keys, where a key may hold a third of all rows."""
    size = free_name(rows.crossJoin(table.drop(key)), "size__")
    groups = settle(rows.groupBy(key).agg(F.count("*").alias(size)).join(table, key, "left"), "keys")
    return join_groups(rows, groups, key, size).drop(size)
