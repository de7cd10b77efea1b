"""Chronological train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scale
from .order import order_events

TRAIN, VAL = 0.6, 0.2


def _cuts(keyed: DataFrame, train: float, val: float):
    """Split sizes and the (v, tie) keys where validation and test begin, for rows ordered by ``v, tie``."""
    n, low, high = keyed.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    ends = int(n * train), int(n * (train + val))
    targets = {i: ("", p) for i, p in enumerate(ends) if p < n}
    found = scale.keys_at(keyed.withColumn("g", F.lit("")), targets, low, high, n) if targets else {}
    return [found.get(i) for i in range(2)]


def _label(v: str, tie: str, cuts):
    """Compare each row with the literal cut keys: a projection, no join and no shuffle."""
    def before(cut):
        if cut is None:
            return F.lit(True)
        return (F.col(v) < cut[0]) | ((F.col(v) == cut[0]) & (F.col(tie) < cut[1]))

    return F.when(before(cuts[0]), "train").when(before(cuts[1]), "val").otherwise("test")


def split_by_rows(log: DataFrame, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """Cut the log at the given shares of its rows in (time_us, event_key) order; cases may straddle."""
    keyed = log.select(F.col("time_us").alias("v"), F.col("event_key").alias("tie"))
    return log.withColumn("split", _label("time_us", "event_key", _cuts(keyed, train, val)))


def split_by_cases(log: DataFrame, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """Cut the cases, ordered by (first event time, case_id), at the given shares; a case stays whole."""
    if "case_start_us" not in log.columns:
        log = order_events(log)
    # Stored: finding the cuts reads the cases several times.
    starts = scale.materialise(log.groupBy(F.col("case_id").alias("tie")).agg(F.min("case_start_us").alias("v")))
    cuts = _cuts(starts, train, val)
    scale.discard(starts)
    return log.withColumn("split", _label("case_start_us", "case_id", cuts))


def split(log: DataFrame, mode: str, train: float = TRAIN, val: float = VAL) -> DataFrame:
    return {"rows": split_by_rows, "cases": split_by_cases}[mode](log, train, val)


def chronological_position(log: DataFrame, limit: int = scale.HOT_ROWS) -> DataFrame:
    """Add ``position``, the 0-based place of every row in (time_us, event_key) order of the whole log.

    Rows are counted per UTC hour; a running sum over the hours gives each hour its offset, and rows are numbered
    within their hour. Hours above ``limit`` rows are numbered in segments.
    """
    hour = F.floor(F.col("time_us") / 3_600_000_000)
    log = log.withColumn("_hour", hour)
    counts = log.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    offsets = scale.running(counts, [], ["_hour"], {"_end": F.col("_n")}, limit)
    offsets = offsets.select("_hour", (F.col("_end") - F.col("_n")).alias("_offset"))
    numbered = scale.running(log, ["_hour"], ["time_us", "event_key"], {"_place": F.lit(1).cast("bigint")}, limit)
    out = scale.lookup_join(numbered, offsets, ["_hour"])
    return out.withColumn("position", F.col("_offset") + F.col("_place") - 1).drop("_hour", "_offset", "_place")
