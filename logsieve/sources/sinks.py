"""Writing logs, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import path_exists

# Files a task of a partitioned write keeps open at once, and the bytes of a row group each of them holds.
OPEN_FILES, ROW_GROUP = 32, 16 << 20


def write_log_once(spark: SparkSession, root: str, dataset: str, runs: list[int], make) -> DataFrame:
    """The prepared log of ``dataset`` for ``runs``: stored runs are read back, missing ones made and stored.

    ``make(runs)`` returns the log with a ``run`` column. Each (dataset, run) is one folder.
    """
    base = f"{root}/dataset={dataset}"
    missing = [r for r in runs if not path_exists(spark, f"{base}/run={r}/_done")]
    if missing:
        made = make(missing)
        (made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run").parquet(base))
        for r in missing:
            mark(spark, f"{base}/run={r}/_done")
    return spark.read.parquet(base).where(F.col("run").isin(runs))


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty marker file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.create(target, True).close()


def write_scores(scores: DataFrame, root: str) -> None:
    """Store long scores partitioned by dataset, run, model and level; a repeated write replaces only its own runs.

    A task keeps a file open per partition, up to ``OPEN_FILES``, with small row groups; only beyond does it sort its rows.
    """
    conf, name = scores.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(OPEN_FILES))
    try:
        (scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("parquet.block.size", str(ROW_GROUP)).partitionBy("dataset", "run", "model", "level").parquet(root))
    finally:
        conf.set(name, before)


def wide_scores(scores: DataFrame, ids: list[str], columns: list[tuple[str, str, str]]) -> DataFrame:
    """The wide layout: one column per (model, level, feature_set), 0.0 where a row was not scored."""
    wide = scores.groupBy(*ids).agg(*[
        F.coalesce(F.max(F.when((F.col("model") == m) & (F.col("level") == lv) & (F.col("feature_set") == fs),
                                F.col("score"))), F.lit(0.0)).alias(f"score_{m}_{lv}_{fs}")
        for m, lv, fs in columns])
    return wide


def write_report(table: DataFrame, path: str) -> None:
    """Store a report as one CSV file with header. Reports hold one row per configuration, never per event."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
