"""Per-level profile of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import order_events, with_stretches
from ..functions.scalars import seconds
from ..sources.spec import has_resource

LEVELS = ("L3_Global", "L2_Activity", "L1_Micro")
MIN_SAMPLES = 30


def with_delta(log: DataFrame) -> DataFrame:
    """Seconds since the previous event of the case; 0 for the first."""
    rows, keys = with_stretches(log)
    w = Window.partitionBy(*keys).orderBy("event_seq")
    rows = rows.withColumn("delta_us", F.coalesce(F.col("time_us") - F.lag("time_us").over(w), F.lit(0)))
    return rows.where(~F.col("_halo")).drop("_halo", "_stretch").withColumn("delta_t", seconds("delta_us"))


def profile(log: DataFrame, levels=LEVELS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row per level: group counts and sizes, dropped groups, and averages of the groups' delta_t statistics.

    All levels come from one GROUPING SETS aggregation. L1 is left out for logs without resource. Rows whose key is
    null belong to no group but stay in total_events.
    """
    if "event_seq" not in log.columns:
        log = order_events(log)
    # Grouping id -> level. The resource set only serves to count distinct resources.
    sets = {3: ("L3_Global", []), 1: ("L2_Activity", ["activity"]),
            0: ("L1_Micro", ["activity", "resource"]), 2: ("resources", ["resource"])}
    if not has_resource(log):
        sets = {i: s for i, s in sets.items() if "resource" not in s[1]}
    rows = with_delta(log).select("activity", "resource", "delta_t")
    groups = (rows.groupingSets([[F.col(c) for c in cols] for _, cols in sets.values()], "activity", "resource")
              .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
                   F.var_samp("delta_t").alias("var"), F.avg("delta_t").alias("mean"),
                   F.min("delta_t").alias("lo"), F.max("delta_t").alias("hi")))
    level, keyed = F.lit(None).cast("string"), F.lit(False)
    for gid, (name, cols) in sets.items():
        level = F.when(F.col("gid") == gid, name).otherwise(level)
        here = F.col("gid") == gid
        for c in cols:
            here = here & F.col(c).isNotNull()
        keyed = keyed | here
    groups = groups.withColumn("level", level).where(keyed)
    kept = (F.col("n") >= min_samples) | (F.col("level") == "L3_Global")
    small = F.col("n") < min_samples

    def mean_of(c):
        return F.coalesce(F.avg(F.when(kept, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))

    per_level = groups.groupBy("level").agg(
        F.count(F.lit(1)).alias("num_models"),
        F.sum("n").alias("total"),
        F.avg("n").alias("avg_events_per_model"),
        # Distinct sizes of disjoint groups number at most sqrt(2 * rows), so the exact median stays small.
        F.median("n").alias("median_events_per_model"),
        F.count_if(small).alias("models_dropped_under_30"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("dropped"),
        mean_of("var").alias("avg_delta_t_variance"), mean_of("mean").alias("m"),
        mean_of("lo").alias("lo"), mean_of("hi").alias("hi"))
    # At most four rows from here on.
    every = Window.partitionBy(F.lit(0))

    def models_of(name):
        return F.coalesce(F.max(F.when(F.col("level") == name, F.col("num_models"))).over(every), F.lit(0))

    out = per_level.withColumns({
        "distinct_activities": models_of("L2_Activity"),
        "distinct_resources": models_of("resources"),
        "total_events": F.max(F.when(F.col("level") == "L3_Global", F.col("total"))).over(every),
    }).where(F.col("level").isin(list(levels)))
    return out.select(
        "level", "distinct_activities", "distinct_resources", "num_models", "total_events",
        "avg_events_per_model", "median_events_per_model", "models_dropped_under_30",
        F.when(F.col("total_events") > 0, F.col("dropped") / F.col("total_events") * 100).otherwise(0.0)
         .alias("percent_events_dropped"),
        "avg_delta_t_variance",
        (F.sqrt("avg_delta_t_variance") / 3600.0).alias("avg_delta_t_std_hours"),
        (F.col("m") / 3600.0).alias("avg_delta_t_mean_hours"),
        (F.col("lo") / 3600.0).alias("avg_delta_t_min_hours"),
        (F.col("hi") / 3600.0).alias("avg_delta_t_max_hours"))


def rounded_profile(table: DataFrame) -> DataFrame:
    """The profile with two decimals, halves to the even neighbour."""
    return table.select(*[F.bround(c, 2).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])
