"""Hourly weather forecasts issued on earlier days, from JSON documents fetched by an injected transport."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import DataSource
from .http import get

#: Variables asked for by default.
VARIABLES = (
    "temperature_2m",
    "rain",
    "showers",
    "snowfall",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "weather_code",
    "surface_pressure",
    "pressure_msl",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
)
API_URL = "https://previous-runs-api.open-meteo.com/v1/forecast"


def http_transport(query: dict) -> str:
    """The service's JSON for a query; refusals come as JSON too."""
    status, body = get(API_URL, {**query, "timezone": "GMT"})
    if status >= 400 and not body.lstrip().startswith("{"):
        raise OSError(f"The weather service refused a request with status {status}")
    return body


def parse_forecast(docs: DataFrame, variables: list[str], horizon: int, prefix: str = "", now: str | None = None) -> DataFrame:
    """Rows of JSON ``doc``: at position x, variable d+i is the i-days-old forecast for 24*i hours later.

    Rows later than 13 hours after ``now`` and rows without any value are dropped. A column ``chunk`` stays.
    """
    kept = [c for c in ("chunk",) if c in docs.columns]
    fields = ", ".join(["time array<string>", *[f"`{v}_previous_day{i}` array<double>" for v in variables for i in range(1, horizon + 1)]])
    rows = docs.select(*kept, F.from_json("doc", f"hourly struct<{fields}>").alias("j")).select(*kept, "j.hourly.*")
    rows = rows.select("*", F.posexplode("time").alias("x", "t"))
    lead = f"{prefix}_" if prefix else ""
    values = [F.get(F.col(f"`{v}_previous_day{i}`"), F.col("x") + 24 * i).alias(f"{lead}{v}_d+{i}") for v in variables for i in range(1, horizon + 1)]
    out = rows.select(*kept, F.to_timestamp("t").alias("ts"), *values)
    if now:
        out = out.filter(F.col("ts") <= F.date_trunc("hour", F.to_timestamp(F.lit(now))) + F.expr("interval 13 hours"))
    return out.dropna(how="all", subset=[c for c in out.columns if c not in ("ts", *kept)])


def merge_chunks(parts: DataFrame) -> DataFrame:
    """One row for each instant of overlapping chunks: each value from the earliest chunk that has it."""
    names = [c for c in parts.columns if c not in ("ts", "chunk")]
    return parts.groupBy("ts").agg(*[F.min_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col("chunk"))).alias(c) for c in names])


class OpenMeteoSource(DataSource):
    """``transport`` gets a dict of query parameters and returns the service's JSON."""

    def __init__(
        self, latitude: float, longitude: float, horizon: int = 7, model: str = "jma_seamless", columns: list[str] | None = None, prefix: str = "",
        transport: Callable[[dict], str] | None = None, clock: Callable[[], dt.datetime] | None = None, sleep: Callable[[float], None] = time.sleep,
    ):
        if not -90 <= latitude <= 90 or not -180 <= longitude <= 180:
            raise ValueError("latitude or longitude out of range")
        if not 1 <= horizon <= 7:
            raise ValueError("horizon must be 1 to 7")
        self.latitude, self.longitude, self.horizon, self.model, self.columns, self.prefix = latitude, longitude, horizon, model, list(columns or VARIABLES), prefix
        self.transport, self.clock, self.sleep = transport or http_transport, clock or (lambda: dt.datetime.now(dt.timezone.utc)), sleep

    def params(self) -> dict:
        return {k: getattr(self, k) for k in ("latitude", "longitude", "horizon", "model", "columns", "prefix")}

    def get_cache_config(self) -> dict:
        return {"source_type": "open_meteo", **self.params()}

    def chunks(self, start: dt.date, end: dt.date, months: int = 3) -> list[tuple[dt.date, dt.date]]:
        """Ranges of some months that overlap by the horizon; the last one ends at ``end``."""
        if months <= 0:
            raise ValueError("months must be positive")
        out, at = [], start
        while at <= end:
            y, m = divmod(at.year * 12 + at.month - 1 + months, 12)
            last = min(dt.date(y, m + 1, min(at.day, 28)), end)
            out.append((at, last))
            if last >= end:
                break
            at = max(last - dt.timedelta(self.horizon), at + dt.timedelta(1))
        return out

    def request(self, start: dt.date, end: dt.date) -> str:
        """One document, with waits by the reason of a refusal and at most five tries."""
        hourly = [f"{c}_previous_day{i}" for c in self.columns for i in range(1, self.horizon + 1)]
        query = {"latitude": self.latitude, "longitude": self.longitude, "models": self.model, "start_date": str(start), "end_date": str(end), "hourly": hourly}
        for attempt in range(5):
            try:
                body = self.transport(query)
            except OSError:
                if attempt == 4:
                    raise
                self.sleep(10)
                continue
            reply = json.loads(body)
            if not reply.get("error"):
                return body
            reason = str(reply.get("reason", "")).lower()
            wait = next((w for k, w in (("minutely", 60), ("concurrent", 10), ("hourly", 3600)) if k in reason), None)
            if wait is None:
                raise ValueError(f"Weather service error: {reply.get('reason')}")
            self.sleep(wait)
        raise RuntimeError("Weather service gave no answer in five tries")

    def fetch(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        if dt.datetime.fromisoformat(str(end)) <= dt.datetime.fromisoformat(str(start)):
            raise ValueError("end must be after start")
        a, b = dt.date.fromisoformat(str(start)[:10]), dt.date.fromisoformat(str(end)[:10]) + dt.timedelta(self.horizon - 1)
        docs = spark.createDataFrame([(i, self.request(*c)) for i, c in enumerate(self.chunks(a, b))], "chunk int, doc string")
        parts = parse_forecast(docs, self.columns, self.horizon, self.prefix, self.clock().strftime("%Y-%m-%d %H:%M:%S"))
        # Days asked for beyond the end, so that the last days have all their forecasts, stay in the result.
        return merge_chunks(parts)
