from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession


class DataSource(ABC):
    """A source gives a frame with a ``ts`` instant for a time range, both ends included."""

    @abstractmethod
    def fetch(self, spark: SparkSession, start: str, end: str) -> DataFrame: ...

    def get_cache_config(self) -> dict | None:
        """What identifies this source's data, or None if it isn't to be cached."""
        return None

    def params(self) -> dict:
        return {}
