"""Validators report on a frame and never stop a pipeline."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import seconds
from .transformers import TS, epoch, numeric


@dataclass
class ValidationResult:
    is_valid: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    info: dict[str, Any] = field(default_factory=dict)
    stats: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.is_valid

    def fail(self, message: str) -> None:
        self.is_valid = False
        self.errors.append(message)


class Validator(ABC):
    @abstractmethod
    def validate(self, df: DataFrame) -> ValidationResult: ...

    def params(self) -> dict:
        return {}


def null_counts(df: DataFrame) -> DataFrame:
    """One row (column, null_count) for each column, from one aggregate over the frame."""
    names = [c for c in df.columns if c != TS]
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_count")) for i, c in enumerate(names)])).alias("s")).select("s.*")


class NullCheckValidator(Validator):
    def __init__(self, columns: list[str] | None = None, allow_nulls: bool = False):
        self.columns, self.allow_nulls = columns, allow_nulls

    def params(self) -> dict:
        return {"columns": self.columns, "allow_nulls": self.allow_nulls}

    def validate(self, df: DataFrame) -> ValidationResult:
        out = ValidationResult()
        if missing := sorted(set(self.columns or []) - set(df.columns)):
            out.fail(f"Missing columns: {missing}")
            out.info["missing_columns"] = missing
        if df.isEmpty():
            out.warnings.append("DataFrame is empty")
            return out
        counts = {r["column"]: r["null_count"] for r in null_counts(df).collect() if r["null_count"]}
        if counts and not self.allow_nulls:
            out.fail(f"Null values: {counts}")
            out.info["null_counts"] = counts
        return out


def gaps(df: DataFrame, freq: str = "1h") -> DataFrame:
    """(start, end, duration in seconds) of steps longer than ``freq``, found by day and between days' ends."""
    day = F.floor(epoch() / 86400)
    rows = df.select(TS, day.alias("d"))
    inside = rows.select(F.lag(TS).over(Window.partitionBy("d").orderBy(TS)).alias("start"), F.col(TS).alias("end"))
    ends = rows.groupBy("d").agg(F.min(TS).alias("a"), F.max(TS).alias("b"))
    between = ends.select(F.lag("b").over(Window.orderBy("d")).alias("start"), F.col("a").alias("end"))
    both = inside.unionByName(between).withColumn("duration", epoch("end") - epoch("start"))
    return both.filter(F.col("duration") > seconds(freq))


class ContinuityValidator(Validator):
    def __init__(self, freq: str = "1h"):
        self.freq = freq

    def params(self) -> dict:
        return {"freq": self.freq}

    def validate(self, df: DataFrame) -> ValidationResult:
        out = ValidationResult()
        if TS not in df.columns or not df.schema[TS].dataType.simpleString().startswith("timestamp"):
            out.fail("No timestamp column")
            return out
        found = gaps(df, self.freq)
        out.stats, count = found, found.count()
        out.info = {"gap_count": count, "expected_freq": self.freq}
        if count:
            out.info["gaps"] = [r.asDict() for r in found.orderBy("start").collect()]
            out.fail(f"{count} gaps in the series")
        return out


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, nulls, min, max, mean, std and quartiles of each numeric column, in one pass."""
    names = [c for c in (columns or numeric(df)) if c in numeric(df)]
    aggs = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        nulls = F.count_if(x.isNull())
        stats = {
            "column": F.lit(c), "count": F.count(x), "null_count": nulls, "null_pct": 100.0 * nulls / F.count(F.lit(1)), "min": F.min(x), "max": F.max(x),
            "mean": F.avg(x), "std": F.stddev_samp(x), "q25": q[0], "q50": q[1], "q75": q[2],
        }
        aggs.append(F.struct(*[v.alias(k) for k, v in stats.items()]).alias(f"s{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s")).select("s.*")


class EdaValidator(Validator):
    def __init__(self, columns: list[str] | None = None):
        self.columns = columns

    def params(self) -> dict:
        return {"columns": self.columns}

    def validate(self, df: DataFrame) -> ValidationResult:
        out = ValidationResult()
        out.warnings += [f"Column not found: {c}" for c in self.columns or [] if c not in df.columns]
        names = [c for c in (self.columns or numeric(df)) if c in numeric(df)]
        if not names:
            out.warnings.append("No numeric columns")
            return out
        out.stats, out.info["columns_analyzed"] = describe(df, names), names
        return out
