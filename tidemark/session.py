"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; the rest is left to whoever starts the cluster.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the required settings; ``master`` and sizes only where the launcher set none."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**REQUIRED, "spark.sql.adaptive.enabled": "true", **extra}.items():
        builder = builder.config(key, value)
    return require_utc(builder.getOrCreate())


def require_utc(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC: instants never move, wall clocks are derived where asked for."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark
