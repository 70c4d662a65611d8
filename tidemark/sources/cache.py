"""A range cache: Parquet chunks of a source beside a manifest of the ranges they cover, in any store that Spark reaches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import keep_first
from . import files
from .base import DataSource


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def uncovered(ranges: list[tuple[str, str]], start: str, end: str) -> list[tuple[str, str]]:
    """What (start, end) lacks of the given ranges, by one sweep over them in order."""
    out, at = [], start
    for a, b in sorted(ranges):
        if a >= end or b <= at:
            continue
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, end)] if at < end else out


class RangeCache:
    def __init__(self, spark: SparkSession, root: str, config: dict):
        self.spark, self.config, self.folder = spark, config, f"{root.rstrip('/')}/{config_key(config)}"
        self.path = f"{self.folder}/metadata.json"

    def manifest(self) -> dict:
        text = files.read_text(self.spark, self.path)
        return json.loads(text) if text else {"cached_ranges": [], "source_config": self.config}

    def missing(self, start: str, end: str) -> list[tuple[str, str]]:
        return uncovered([(r["start"], r["end"]) for r in self.manifest()["cached_ranges"]], start, end)

    def write(self, df: DataFrame, start: str, end: str) -> None:
        """Store a chunk; an empty one is recorded as a range without a file, so it isn't fetched again."""
        name = None if df.isEmpty() else "data_" + "_".join(x.translate(str.maketrans("", "", "-:T ")) for x in (start, end))
        if name:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        state = self.manifest()
        state["cached_ranges"] = [r for r in state["cached_ranges"] if (r["start"], r["end"]) != (start, end)] + [{"start": start, "end": end, "filename": name}]
        files.write_text(self.spark, self.path, json.dumps(state))

    def read(self, start: str, end: str) -> DataFrame | None:
        """Rows of the chunks that overlap the range; of an instant in several the first written stays."""
        parts = None
        for i, r in enumerate(self.manifest()["cached_ranges"]):
            if r["filename"] and r["start"] < end and r["end"] > start or r["filename"] and r["start"] <= start <= r["end"]:
                part = self.spark.read.parquet(f"{self.folder}/{r['filename']}").withColumn("__order", F.lit(i))
                parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        if parts is None:
            return None
        inside = parts.filter(F.col("ts").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))
        return keep_first(inside, "__order").drop("__order")

    def info(self) -> dict:
        return {"folder": self.folder, **self.manifest()}

    def fetch(self, source: DataSource, start: str, end: str) -> DataFrame:
        for a, b in self.missing(start, end):
            self.write(source.fetch(self.spark, a, b), a, b)
        found = self.read(start, end)
        return found if found is not None else source.fetch(self.spark, start, end)
