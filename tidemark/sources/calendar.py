"""Calendar features as a generated source: local hours, weekdays, months, public holidays and daylight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import DataSource
from .holidays import holidays as public_holidays

#: Zone, latitude and longitude of each country's capital.
COUNTRIES = {
    "AT": ("Europe/Vienna", 48.2082, 16.3738),
    "BE": ("Europe/Brussels", 50.8503, 4.3517),
    "BG": ("Europe/Sofia", 42.6977, 23.3219),
    "CH": ("Europe/Zurich", 46.9480, 7.4474),
    "CZ": ("Europe/Prague", 50.0755, 14.4378),
    "DE": ("Europe/Berlin", 52.5200, 13.4050),
    "DK": ("Europe/Copenhagen", 55.6761, 12.5683),
    "ES": ("Europe/Madrid", 40.4168, -3.7038),
    "FI": ("Europe/Helsinki", 60.1699, 24.9384),
    "FR": ("Europe/Paris", 48.8566, 2.3522),
    "GB": ("Europe/London", 51.5074, -0.1278),
    "GR": ("Europe/Athens", 37.9838, 23.7275),
    "HU": ("Europe/Budapest", 47.4979, 19.0402),
    "IE": ("Europe/Dublin", 53.3498, -6.2603),
    "IT": ("Europe/Rome", 41.9028, 12.4964),
    "NL": ("Europe/Amsterdam", 52.3676, 4.9041),
    "NO": ("Europe/Oslo", 59.9139, 10.7522),
    "PL": ("Europe/Warsaw", 52.2297, 21.0122),
    "PT": ("Europe/Lisbon", 38.7223, -9.1393),
    "RO": ("Europe/Bucharest", 44.4268, 26.1025),
    "SE": ("Europe/Stockholm", 59.3293, 18.0686),
    "SK": ("Europe/Bratislava", 48.1486, 17.1077),
}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def daylight(day: Column, lat: float, lon: float) -> tuple[Column, Column]:
    """Sunrise and sunset in UTC hours of a day, by the almanac's low-precision solar equations; null in polar day or night."""
    n = F.datediff(day, F.to_date(F.lit("2000-01-01"))) - lon / 360.0
    mean = F.radians((357.5291 + 0.98560028 * n) % 360)
    centre = 1.9148 * F.sin(mean) + 0.02 * F.sin(2 * mean) + 0.0003 * F.sin(3 * mean)
    along = F.radians((F.degrees(mean) + centre + 180 + 102.9372) % 360)
    noon = 12 - lon / 15.0 + 24 * (0.0053 * F.sin(mean) - 0.0069 * F.sin(2 * along))
    tilt = F.asin(F.sin(along) * math.sin(math.radians(23.44)))
    cos_h = (math.sin(math.radians(-0.833)) - math.sin(math.radians(lat)) * F.sin(tilt)) / (math.cos(math.radians(lat)) * F.cos(tilt))
    half = F.when(F.abs(cos_h) <= 1, F.degrees(F.acos(cos_h)) / 15)
    return noon - half, noon + half


class CalendarSource(DataSource):
    def __init__(
        self, country: str, timezone: str | None = None, holidays: str | bool = "binary", weekday: str | bool = "number",
        hour: str | bool = False, month: str | bool = False, daylight: bool = False, prefix: str = "",
    ):
        country = country.upper()
        if country not in COUNTRIES:
            raise ValueError(f"Unknown country: {country}")
        allowed = {"holidays": ("binary", "name", "onehot", False), "weekday": ("number", "name", "onehot", False), "hour": ("number", "onehot", False), "month": ("number", "name", "onehot", False)}
        for name, value in (("holidays", holidays), ("weekday", weekday), ("hour", hour), ("month", month)):
            if value not in allowed[name]:
                raise ValueError(f"Invalid option for {name}: {value!r}")
        self.country, self.timezone = country, timezone or COUNTRIES[country][0]
        self.holidays, self.weekday, self.hour, self.month, self.daylight, self.prefix = holidays, weekday, hour, month, daylight, prefix

    def params(self) -> dict:
        return {k: getattr(self, k) for k in ("country", "timezone", "holidays", "weekday", "hour", "month", "daylight", "prefix")}

    def fetch(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        a, b = spark.range(1).select(*[F.unix_timestamp(F.to_timestamp(F.lit(str(x)))) for x in (start, end)]).first()
        return self.describe(spark.range(a, b + 1, 3600).select(F.timestamp_seconds("id").alias("ts")))

    def describe(self, df: DataFrame) -> DataFrame:
        """Features of any frame's instants; the holiday table, a few rows for each year, is broadcast."""
        local, p, spark = F.from_utc_timestamp("ts", self.timezone), self.prefix, df.sparkSession
        cols: list[Column] = []
        if self.holidays:
            years = df.agg(F.min(F.year(local)), F.max(F.year(local))).first()
            table = public_holidays(self.country, range(years[0] or 2000, (years[1] or 2000) + 1))
            dim = spark.createDataFrame(sorted(table.items()), "__day date, __holiday string")
            df = df.join(F.broadcast(dim), F.to_date(local) == F.col("__day"), "left")
            if self.holidays in ("binary", "onehot"):
                cols.append(F.col("__holiday").isNotNull().cast("int").alias(f"{p}is_holiday"))
            if self.holidays == "name":
                cols.append(F.col("__holiday").alias(f"{p}holiday_name"))
            if self.holidays == "onehot":
                cols += [F.coalesce(F.col("__holiday") == n, F.lit(False)).cast("int").alias(f"{p}holiday_{n}") for n in sorted(set(table.values()))]
        fields = (
            (self.weekday, F.weekday(local), "weekday", DAYS, 0),
            (self.hour, F.hour(local), "hour", tuple(map(str, range(24))), 0),
            (self.month, F.month(local), "month", MONTHS, 1),
        )
        for mode, number, stem, names, base in fields:
            if mode == "number":
                cols.append(number.alias(f"{p}{stem}"))
            elif mode == "name":
                cols.append(F.element_at(F.array(*map(F.lit, names)), number - base + 1).alias(f"{p}{stem}_name"))
            elif mode == "onehot":
                cols += [(number == i + base).cast("int").alias(f"{p}is_{n}") for i, n in enumerate(names)]
        if self.daylight:
            _, lat, lon = COUNTRIES[self.country]
            rise, fall = daylight(F.to_date(local), lat, lon)
            shift = (F.unix_timestamp(local) - F.unix_timestamp("ts")) / 3600.0
            to_minute = lambda x: F.floor((x + shift) * 60) / 60
            cols += [to_minute(rise).alias(f"{p}sunrise"), to_minute(fall).alias(f"{p}sunset"), (fall - rise).alias(f"{p}daylight_hours")]
        return df.select("ts", *cols)
