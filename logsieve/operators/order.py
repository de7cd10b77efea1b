"""Event order within cases, fixed once before anything moves a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scale

# Rows of one case that one window task works on; longer cases are cut into stretches of this length.
STRETCH = 1_000_000
# Rows a stretch borrows from its predecessor: three earlier gaps need four earlier events.
HALO = 4


def order_events(log: DataFrame, limit: int = scale.HOT_ROWS) -> DataFrame:
    """Add event_seq (1-based place in the case), trace_len and case_start_us.

    The order is (time_us, event_key). Cases above ``limit`` events are ranked in segments. The schema remembers
    whether such cases exist, so later windows know without counting again.
    """
    light, hot = scale.part_heavy(log, ["case_id"], ["time_us", "event_key"], limit)
    whole = Window.partitionBy("case_id")
    out = light.withColumns({
        "event_seq": F.row_number().over(whole.orderBy("time_us", "event_key")).cast("bigint"),
        "trace_len": F.count("activity").over(whole),
        "case_start_us": F.min("time_us").over(whole),
    })
    if hot is not None:
        hot = scale.running(hot.drop("_seg"), ["case_id"], ["time_us", "event_key"],
                            {"event_seq": F.lit(1).cast("bigint")}, limit)
        facts = hot.groupBy("case_id").agg(F.count("activity").alias("trace_len"),
                                           F.min("time_us").alias("case_start_us"))
        # One row per heavy case, fewer than MAX_HEAVY_KEYS.
        out = out.unionByName(hot.join(F.broadcast(facts), "case_id"))
    return out.withColumn("event_seq", F.col("event_seq").alias("event_seq", metadata={"long_cases": hot is not None}))


def has_long_cases(log: DataFrame) -> bool:
    return bool(log.schema["event_seq"].metadata.get("long_cases", True))


def case_keys(log: DataFrame) -> list[str]:
    return [c for c in ("run", "case_id") if c in log.columns]


def with_stretches(log: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, list[str]]:
    """Cut long cases into stretches and lend each stretch the last rows of the one before it.

    Returns the log and the window partition columns. Borrowed rows carry ``_halo`` = true and have to be dropped
    after the windows ran. Stretches come from event_seq by arithmetic: no join, no shuffle.
    """
    keys = case_keys(log)
    if not has_long_cases(log):
        return log.withColumn("_halo", F.lit(False)), keys
    place = F.col("event_seq") - 1
    own = F.floor(place / stretch)
    lent = F.pmod(place, F.lit(stretch)) >= stretch - HALO
    homes = F.when(lent, F.array(own, own + 1)).otherwise(F.array(own))
    log = log.withColumn("_own", own).withColumn("_stretch", F.explode(homes))
    log = log.withColumn("_halo", F.col("_stretch") != F.col("_own")).drop("_own")
    return log, [*keys, "_stretch"]
