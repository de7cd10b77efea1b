"""A local Spark session for tests and benchmarks; on a cluster, use the session given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "logsieve", memory: str = "12g", **conf) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
