"""Transformers: DataFrame to DataFrame over a ``ts`` instant column. They compose into one lazy plan."""

from __future__ import annotations

import zoneinfo
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.durations import lag_name, seconds
from ..functions.rounding import half_even

TS = "ts"
#: Rows of one time bucket when a running fill is split into pieces.
DAY = 86400


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def epoch(ts: Column | str = TS) -> Column:
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


class Transformer(ABC):
    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def params(self) -> dict:
        return {}

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


class TimezoneTransformer(Transformer):
    """Instants stay; the zone goes with the frame as metadata of ``ts`` and rules what wall-clock fields mean."""

    def __init__(self, target_tz: str):
        if target_tz not in zoneinfo.available_timezones():
            raise ValueError(f"Invalid timezone: {target_tz}")
        self.target_tz = target_tz

    def params(self) -> dict:
        return {"target_tz": self.target_tz}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withMetadata(TS, {"tz": self.target_tz})


def zone_of(df: DataFrame) -> str:
    return df.schema[TS].metadata.get("tz", "UTC")


def local_time(df: DataFrame) -> Column:
    return F.from_utc_timestamp(F.col(TS), zone_of(df))


class ResampleTransformer(Transformer):
    """Rows on a regular grid from the first day's local midnight on, gaps filled as asked, numbers rounded to 3 places.

    Only exact grid rows are taken; nothing is averaged. Running fills are found for days first, then inside each day,
    so no window spans the whole series. An instant that occurs twice has no one value: the job fails.
    """

    def __init__(self, freq: str = "1h", method: str = "linear", columns: str | list[str] | None = None):
        if method not in ("linear", "ffill", "bfill"):
            raise ValueError(f"Unknown interpolation method: {method}")
        self.freq, self.method, self.step = freq, method, seconds(freq)
        self.columns = [columns] if isinstance(columns, str) else columns

    def params(self) -> dict:
        return {"freq": self.freq, "method": self.method, "columns": self.columns}

    def transform(self, df: DataFrame) -> DataFrame:
        if missing := sorted(set(self.columns or []) - set(df.columns)):
            raise ValueError(f"Columns not found: {missing}")
        tz = zone_of(df)
        midnight = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(F.min(TS), tz)), tz)
        ends = df.agg(epoch(midnight).alias("a"), F.min(epoch()).alias("m"), F.max(epoch()).alias("b")).filter("b is not null")
        first = F.expr(f"a + floor((m - a) / {self.step}) * {self.step}")
        if self.step < DAY or tz == "UTC":
            # By spans first, so that no one row holds the whole grid.
            span = 4096 * self.step
            spans = ends.select(F.explode(F.sequence(first, F.col("b"), F.lit(span))).alias("__from"), "b")
            grid = spans.select(F.explode(F.sequence("__from", F.least(F.col("__from") + (span - self.step), F.col("b")), F.lit(self.step))).alias("__s"))
        else:  # days of a zone: their length varies, their number is small
            local = [F.from_utc_timestamp(F.timestamp_seconds(c), tz) for c in ("a", "b")]
            steps = F.sequence(*local, F.expr(f"interval {self.step // DAY} days"))
            grid = ends.select(F.explode(steps).alias("__l")).select(epoch(F.to_utc_timestamp("__l", tz)).alias("__s"))
        placed = df.filter(F.date_trunc("second", TS) == F.col(TS)).withColumn("__s", epoch())
        said = F.concat(F.lit("Duplicate instant: "), F.col(TS).cast("string"))
        again = F.count("*").over(Window.partitionBy("__s")) > 1
        placed = placed.withColumn("__s", F.when(again, F.raise_error(said).cast("long")).otherwise(F.col("__s"))).drop(TS)
        joined = grid.join(placed, "__s", "left")
        fill = [c for c in numeric(df) if self.columns is None or c in self.columns]
        out = self._fill(joined, fill) if fill else joined
        ts = F.timestamp_seconds("__s").alias(TS, metadata=df.schema[TS].metadata)
        rounded = lambda c: half_even(F.col(f"`{c}`").cast("double")).alias(c)
        return out.select(ts, *[rounded(c) if c in numeric(df) else F.col(f"`{c}`") for c in df.columns if c != TS])

    def _fill(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        rows = rows.withColumn("__d", F.floor(F.col("__s") / DAY))
        value_of = lambda c: F.struct(F.col("__s").alias("t"), F.col(f"`{c}`").cast("double").alias("v"))
        points = [(i, F.when(F.col(f"`{c}`").isNotNull(), value_of(c))) for i, c in enumerate(columns)]
        days = rows.groupBy("__d").agg(*[F.max(p).alias(f"__p{i}") for i, p in points], *[F.min(p).alias(f"__n{i}") for i, p in points])
        ahead = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.orderBy("__d").rowsBetween(1, Window.unboundedFollowing)
        last = [F.last(f"__p{i}", True).over(ahead).alias(f"__p{i}") for i, _ in points]
        days = days.select("__d", *last, *[F.first(f"__n{i}", True).over(after).alias(f"__n{i}") for i, _ in points])
        back = Window.partitionBy("__d").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
        on = Window.partitionBy("__d").orderBy("__s").rowsBetween(0, Window.unboundedFollowing)
        behind = [F.coalesce(F.last(p, True).over(back), F.col(f"__p{i}")).alias(f"__b{i}") for i, p in points]
        before = [F.coalesce(F.first(p, True).over(on), F.col(f"__n{i}")).alias(f"__a{i}") for i, p in points]
        near = rows.join(days, "__d").select("*", *behind, *before)
        for i, c in enumerate(columns):
            b, a = F.col(f"__b{i}"), F.col(f"__a{i}")
            if self.method == "ffill":
                value = b["v"]
            elif self.method == "bfill":
                value = a["v"]
            else:  # ends are not extrapolated backward; forward the last value stays
                value = F.when(b["t"] == F.col("__s"), b["v"]).when(a.isNull(), b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * (F.col("__s") - b["t"]) / (a["t"] - b["t"]))
            near = near.withColumn(c, value)
        return near


class LagTransformer(Transformer):
    """The value at exactly ``ts - lag * freq``; a missing instant gives null.

    Time is cut into buckets as long as the longest lag, so what a row looks for is in its own bucket or the next one.
    Rows go to both, whatever the number of lags, and all lags are range frames over one sort of a bucket.
    """

    def __init__(self, columns: str | list[str], lags: int | list[int] = 1, freq: str = "1h"):
        self.columns = [columns] if isinstance(columns, str) else list(columns or [])
        if not self.columns:
            raise ValueError("LagTransformer needs columns")
        self.lags, self.freq, self.step = ([lags] if isinstance(lags, int) else list(lags)), freq, seconds(freq)
        if not self.lags:
            raise ValueError("LagTransformer needs lags")

    def params(self) -> dict:
        return {"columns": self.columns, "lags": self.lags, "freq": self.freq}

    def transform(self, df: DataFrame) -> DataFrame:
        missing = sorted(set(self.columns) - set(df.columns))
        if missing:
            raise ValueError(f"Columns not found: {missing}")
        names = [(lag, c, lag_name(c, lag, self.step)) for lag in self.lags for c in self.columns]
        span = max(DAY, self.step * max(abs(lag) for lag in self.lags))
        ways = [0, *([1] if max(self.lags) > 0 else []), *([-1] if min(self.lags) < 0 else [])]
        at = F.unix_micros(F.col(TS))
        placed = df.select("*", F.explode(F.array(*map(F.lit, ways))).alias("__way"), at.alias("__at"))
        placed = placed.withColumn("__bucket", F.floor(F.col("__at") / (span * 1_000_000)) + F.col("__way"))
        bucket, found = Window.partitionBy("__bucket").orderBy("__at"), []
        for lag, c, name in names:
            there = bucket.rangeBetween(-lag * self.step * 1_000_000, -lag * self.step * 1_000_000)
            found.append(F.when(F.col("__at").isNotNull(), F.first(f"`{c}`", True).over(there)).alias(name))
        out = placed.select(*[F.col(f"`{c}`") for c in df.columns], "__way", *found).filter("__way = 0")
        return out.drop("__way")
