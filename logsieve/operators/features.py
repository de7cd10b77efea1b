"""Per-event features within the case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scale
from .order import HALO, STRETCH, has_long_cases, with_stretches
from ..functions import scalars as S

# Fixed value: stands for a missing activity or resource, and for a missing first predecessor.
MISSING = "0"
START = "START"


def base_features(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Add time gaps, place in the case, rework, momentum, cyclic time and density.

    All windows share the partitioning by case (and stretch), so the log is shuffled once. Gaps follow event_seq and
    may be negative after timestamps were moved.
    """
    rows, keys = with_stretches(log, stretch)
    w = Window.partitionBy(*keys).orderBy("event_seq")
    activity = F.coalesce(F.col("activity"), F.lit(MISSING))
    rows = rows.withColumn("activity", activity)
    rows = rows.withColumns({
        "prev_act": F.lag("activity", 1, START).over(w),
        "delta_us": F.coalesce(F.col("time_us") - F.lag("time_us").over(w), F.lit(0)),
    }).withColumn("delta_t", S.seconds("delta_us"))
    rows = rows.withColumn("rolling_delta_t_mean",
                           F.coalesce(F.avg("delta_t").over(w.rowsBetween(-3, -1)), F.lit(0.0)))
    own = F.when(F.col("_halo"), 0).otherwise(1).cast("bigint")
    same = Window.partitionBy(*keys, "activity").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("act_rework_count", F.sum(own).over(same) - 1).where(~F.col("_halo"))
    if has_long_cases(log):
        rows = _carry_rework(rows, keys, stretch)
    rows = rows.drop("_halo", "_stretch")

    hour, day = S.fractional_hour(F.col("time_us")), S.weekday(F.col("time_us"))
    hour_sin, hour_cos = S.cyclic(hour, 24.0)
    day_sin, day_cos = S.cyclic(day, 7.0)
    cum = (F.col("time_us") - F.col("case_start_us")) / F.lit(1e6)
    return rows.withColumns({
        "cum_t": cum,
        "event_idx": F.col("event_seq"),
        "trace_pos": F.col("event_seq") / F.col("trace_len"),
        "momentum_ratio": S.momentum_ratio(F.col("delta_t"), F.col("rolling_delta_t_mean")),
        "weekday": day,
        "hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos,
        "hour_linear": hour / 24.0, "day_linear": day / F.lit(6.0),
        "event_density": S.event_density(F.col("event_seq"), cum),
    })


def _carry_rework(rows: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """Add the repetitions seen in earlier stretches of the same long case."""
    counts = (rows.where(F.col("trace_len") > stretch - HALO).groupBy(*keys, "activity")
              .agg(F.count(F.lit(1)).alias("_here")))
    case = [k for k in keys if k != "_stretch"]
    before = (Window.partitionBy(*case, "activity").orderBy("_stretch")
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select(*keys, "activity", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"))
    rows = scale.lookup_join(rows, earlier, [*keys, "activity"])
    return (rows.withColumn("act_rework_count", F.col("act_rework_count") + F.coalesce("_before", F.lit(0)))
            .drop("_before"))
