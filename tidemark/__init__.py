"""tidemark: hourly time-series preparation and rolling back-tests, declared as Spark plans."""

__version__ = "0.1.0"


def verify(show=print) -> dict[str, str]:
    """What this installation runs on, shown as a table and returned."""
    import os
    import platform
    import sys

    import pyspark
    from pyspark.sql import SparkSession

    free = hasattr(sys, "_is_gil_enabled") and not sys._is_gil_enabled()
    found = {
        "tidemark": __version__,
        "Python": sys.version.split()[0],
        "GIL": "free-threading" if free else "locked",
        "Platform": platform.platform(),
        "CPU cores": str(os.cpu_count() or 1),
        "PySpark": pyspark.__version__,
    }
    if spark := SparkSession.getActiveSession():
        system = spark.sparkContext._jvm.System
        found |= {"Java": system.getProperty("java.version"), "Master": spark.sparkContext.master, "Default parallelism": str(spark.sparkContext.defaultParallelism)}
    width = max(map(len, found))
    show("\n".join(f"{k.ljust(width)}  {v}" for k, v in found.items()))
    return found
