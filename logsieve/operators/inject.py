"""Reproducible anomaly injection: activity swaps and timestamp shifts, per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scale
from .order import with_stretches
from ..functions import scalars as S

RATE = 0.1


def smallest(pool: DataFrame, n: int, runs: list[int], purpose: str, seed: int, rows: int | None = None) -> Column:
    """A condition true for exactly ``n`` rows of ``pool`` per run: those with the smallest (hash, event_key).

    ``pool`` has ``run`` and ``event_key``. The cut keys come from radix selection, so the condition compares each
    row with one literal of its run: nothing is sorted, joined or shuffled.
    """
    if n <= 0:
        return F.lit(False)
    h = S.hash32(purpose, seed, F.col("run"), F.col("event_key"))
    keyed = pool.select(F.col("run").cast("string").alias("g"), h.alias("v"), F.col("event_key").alias("tie"))
    last = scale.keys_at(keyed, {r: (str(r), n - 1) for r in runs}, 0, S.HASH_RANGE - 1, rows)
    bounds = [c for r, (v, tie) in last.items()
              for c in (F.lit(r), F.struct(F.lit(v).cast("bigint").alias("h"), F.lit(tie).alias("k")))]
    return (F.struct(h.alias("h"), F.col("event_key").alias("k"))
            <= F.element_at(F.create_map(*bounds), F.col("run")))


def exact_moments(whole: Column) -> tuple[Column, Column]:
    """Mean and sample standard deviation (0 of a single value) of whole numbers, as aggregates.

    Count, sum and sum of squares are exact integers of up to 38 digits, and so is n * sum of squares - sum ** 2 where it
    fits; only the last division and root are rounded. So the result does not depend on the order of summation.
    """
    n = F.count(whole)
    total = F.sum(whole.cast("decimal(19,0)"))
    squares = F.sum((whole.cast("decimal(19,0)") * whole.cast("decimal(19,0)")).cast("decimal(38,0)"))
    mean = total.cast("double") / n
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(19,0)"), squares), F.try_multiply(total, total)).cast("double")
    spread = F.coalesce(exact, n * squares.cast("double") - total.cast("double") * total.cast("double"))
    std = F.sqrt(F.greatest(spread, F.lit(0.0)) / (n * (n - 1.0)))
    return mean, F.when(n > 1, std).otherwise(F.lit(0.0))


def with_runs(log: DataFrame, runs: list[int]) -> DataFrame:
    """Repeat the log once per run; the run is a column, so one job covers all runs."""
    return log.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))


def inject_anomalies(log: DataFrame, rate: float = RATE, runs=tuple(range(1, 11)), seed: int = 7) -> DataFrame:
    """Swap floor(rows * rate) activities and delay as many non-first events, independently for each run.

    A swapped activity becomes another label of the log, chosen evenly. A delayed event is moved so that its gap
    reaches (mean + std) * (1 + r) of its present activity, where that is longer than its gap; mean and std are those
    of the untouched log and r is uniform in [0, 1). event_seq is left as it was. Adds run, activity_label,
    time_label and is_true_anomaly (the delayed events).
    """
    runs = list(runs)
    facts = log.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_seq") > 1).alias("later"),
                    F.countDistinct("activity").alias("labels")).first()
    n = int(facts["n"] * rate)
    if facts["later"] < n:
        raise ValueError(f"{n} events are to be delayed but only {facts['later']} are not first in their case")
    k, total = facts["labels"], facts["n"] * len(runs)
    labels = log.select("activity").where(F.col("activity").isNotNull()).distinct()
    labels = scale.running(labels, [], ["activity"], {"_i": F.lit(1).cast("bigint")}, total=k)
    if n > 0 and k < 2:
        raise ValueError("activities cannot be swapped in a log with a single activity")

    # Gaps of the untouched log, while its rows are still partitioned by case.
    rows, keys = with_stretches(log)
    w = Window.partitionBy(*keys).orderBy("event_seq")
    gap = F.coalesce(F.col("time_us") - F.lag("time_us").over(w), F.lit(0))
    rows = rows.withColumn("_gap_us", gap).where(~F.col("_halo")).drop("_halo", "_stretch")
    mean, std = exact_moments(F.col("_gap_us"))
    stats = rows.where(F.col("_gap_us") > 0).groupBy("activity").agg(mean.alias("_mean"), std.alias("_std"))

    base = with_runs(log.select("event_key", "event_seq"), runs)
    rows = with_runs(rows, runs)
    rows = rows.withColumn("activity_label", smallest(base, n, runs, "activity", seed, total).cast("int"))
    late = (F.col("event_seq") > 1) & smallest(base.where("event_seq > 1"), n, runs, "time", seed, total)
    rows = rows.withColumn("time_label", late.cast("int"))

    # Own label number, then the picked one: numbers run from 1 to k and the own one is skipped.
    rows = scale.lookup_join(rows, labels, ["activity"], k)
    step = F.floor(S.uniform("label", seed, F.col("run"), F.col("event_key")) * (k - 1)).cast("bigint")
    pick = F.when(step + 1 >= F.col("_i"), step + 2).otherwise(step + 1)
    rows = rows.withColumn("_i", F.when(F.col("activity_label") == 1, pick)).withColumnRenamed("activity", "_old")
    rows = scale.lookup_join(rows, labels, ["_i"], k)
    rows = rows.withColumn("activity", F.coalesce("activity", "_old"))

    # As many stats rows as labels at most.
    rows = scale.lookup_join(rows, stats, ["activity"], k)
    reach = ((F.coalesce("_mean", F.lit(0.0)) + F.coalesce("_std", F.lit(0.0)))
             * (1.0 + S.uniform("reach", seed, F.col("run"), F.col("event_key"))))
    shift_us = F.floor(F.greatest(F.lit(0.0), reach - F.col("_gap_us")) + 0.5).cast("bigint")
    rows = rows.withColumn("_shift_us", F.when(F.col("time_label") == 1, shift_us).otherwise(F.lit(0)))
    return rows.select(
        *[c for c in log.columns if c not in ("activity", "time", "time_us")], "run", "activity",
        S.add_seconds("time", "_shift_us").alias("time"), (F.col("time_us") + F.col("_shift_us")).alias("time_us"),
        "activity_label", "time_label", F.col("time_label").alias("is_true_anomaly"))
