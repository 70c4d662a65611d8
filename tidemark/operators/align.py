"""Set-wise operators on time-series frames: alignment, dedup, interval differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .transformers import TS


def outer_align(frames: Sequence[DataFrame]) -> DataFrame:
    """All instants of all frames with their columns side by side, by one union and one shuffle.

    An instant that one of several frames holds twice can't be aligned: the job fails. A single frame passes as it is.
    """
    names = [c for f in frames for c in f.columns if c != TS]
    if len(set(names)) < len(names):
        raise ValueError(f"Duplicate column names: {sorted({c for c in names if names.count(c) > 1})}")
    if len(frames) == 1:
        return frames[0]
    whole = frames[0].withColumn("__frame", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        whole = whole.unionByName(f.withColumn("__frame", F.lit(i)), allowMissingColumns=True)
    twice = [F.count_if(F.col("__frame") == i) > 1 for i in range(len(frames))]
    found = whole.groupBy(TS).agg(F.greatest(*twice).alias("__twice"), *[F.first(f"`{c}`", True).alias(c) for c in names])
    return unique_instants(found, F.col("__twice")).drop("__twice")


def unique_instants(df: DataFrame, twice: Column) -> DataFrame:
    """``df`` as it is, but reading an instant for which ``twice`` holds fails."""
    said = F.concat(F.lit("Duplicate instant: "), F.col(TS).cast("string"))
    return df.withColumn(TS, F.when(twice, F.raise_error(said).cast("timestamp")).otherwise(F.col(TS)))


def keep_first(df: DataFrame, order: str, key: str = TS) -> DataFrame:
    """Of rows with the same key the one first in ``order``; a partial aggregate, so duplicates need no window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("s")).select(key, "s.*")


def missing_ranges(cached: DataFrame, start: str, end: str) -> DataFrame:
    """(start, end) of what a request lacks, given rows (start, end) already there: gaps between islands."""
    a, b = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    some = cached.filter((F.col("start") < b) & (F.col("end") > a)).select("start", "end")
    edges = some.unionByName(some.sparkSession.range(1).select(b.alias("start"), b.alias("end")))
    before = Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = edges.withColumn("reach", F.greatest(F.coalesce(F.max("end").over(before), a), a))
    return reach.filter(F.col("start") > F.col("reach")).select(F.col("reach").alias("start"), F.least("start", b).alias("end"))


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str] = ("hour", "horizon", "day_in_test")) -> DataFrame:
    return tasks.join(done.select(*keys), list(keys), "left_anti")
