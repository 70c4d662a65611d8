"""Delimited files as a source."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import files
from .base import DataSource

#: Strftime directives and their date-time pattern letters.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
    "%z": "xx", "%p": "a", "%I": "hh", "%j": "DDD", "%b": "MMM", "%B": "MMMM",
}


def pattern_of(strftime: str) -> str:
    return re.sub(r"%[A-Za-z]|[A-Za-z]+", lambda m: DIRECTIVES[m[0]] if m[0] in DIRECTIVES else f"'{m[0]}'", strftime)


def _there(path: str) -> bool:
    """Whether the file is there, in the store of the active session or, without one, of this machine."""
    spark = SparkSession.getActiveSession()
    return files.exists(spark, path) if spark else os.path.exists(path)


class CsvSource(DataSource):
    """Instants are UTC. ``datetime_format`` is a strftime pattern; without it Spark reads the instants."""

    def __init__(
        self, file_path: str, datetime_column: str = "datetime", columns: list[str] | None = None, prefix: str = "",
        datetime_format: str | None = None, separator: str = ",",
    ):
        if not _there(str(file_path)):
            raise FileNotFoundError(f"No such file: {file_path}")
        if not str(file_path).lower().endswith(".csv"):
            raise ValueError(f"Not a .csv file: {file_path}")
        if not datetime_column:
            raise ValueError("datetime_column must not be empty")
        self.file_path, self.datetime_column, self.columns = str(file_path), datetime_column, columns
        self.prefix, self.datetime_format, self.separator = prefix, datetime_format, separator

    def params(self) -> dict:
        return {k: getattr(self, k) for k in ("file_path", "datetime_column", "columns", "prefix", "datetime_format", "separator")}

    def fetch(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        a, b = F.to_timestamp(F.lit(str(start))), F.to_timestamp(F.lit(str(end)))
        if not spark.range(1).select((b > a).alias("ok")).first()[0]:
            raise ValueError("end must be after start")
        raw = spark.read.csv(self.file_path, header=True, sep=self.separator, inferSchema=True)
        if missing := sorted({self.datetime_column, *(self.columns or [])} - set(raw.columns)):
            raise ValueError(f"Columns not found: {missing}")
        time = F.col(f"`{self.datetime_column}`")
        if self.datetime_format:  # as it stands in the file: inference would turn some formats into instants
            as_text = StructType([StructField(f.name, StringType()) if f.name == self.datetime_column else f for f in raw.schema])
            raw = spark.read.schema(as_text).csv(self.file_path, header=True, sep=self.separator)
            ts = F.to_timestamp(time, pattern_of(self.datetime_format))
        else:
            ts = time.cast("timestamp")
        names = self.columns or [c for c in raw.columns if c != self.datetime_column]
        lead = f"{self.prefix}_" if self.prefix else ""
        return raw.select(ts.alias("ts"), *[F.col(f"`{c}`").alias(f"{lead}{c}") for c in names]).filter(F.col("ts").between(a, b))
