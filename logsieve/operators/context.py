"""Context features: statistics fitted on training events, z-scores for all, and resource workload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scale
from .features import MISSING
from ..functions import scalars as S
from ..sources.spec import has_resource

# Grain -> (key columns, value column, output suffix of expected_*, output suffix of z_score_*).
GRAINS = {
    "activity": (["activity"], "delta_t", "act_duration", "act"),
    "transition": (["prev_act", "activity"], "delta_t", "trans_duration", "transition"),
    "act_day": (["activity", "weekday"], "delta_t", "act_day_duration", "act_day"),
    "resource": (["resource"], "delta_t", "res_duration", "res"),
    "micro": (["activity", "resource"], "delta_t", "micro_duration", "micro"),
    "res_day": (["resource", "weekday"], "delta_t", "res_day_duration", "res_day"),
    "act_res_day": (["activity", "weekday", "resource"], "delta_t", "act_res_day_duration", "act_res_day"),
    "cum_t": (["event_idx"], "cum_t", "cum_t", "cum_t"),
}
RESOURCE_GRAINS = [g for g, (keys, *_) in GRAINS.items() if "resource" in keys]
KEY_COLUMNS = ["activity", "prev_act", "weekday", "resource", "event_idx"]


def _filled(feats: DataFrame) -> DataFrame:
    return feats.withColumn("resource", F.coalesce(F.col("resource"), F.lit(MISSING)).alias(
        "resource", metadata=feats.schema["resource"].metadata))


def usable_grains(feats: DataFrame, grains=None) -> list[str]:
    grains = list(GRAINS if grains is None else grains)
    return grains if has_resource(feats) else [g for g in grains if g not in RESOURCE_GRAINS]


def fit_context_stats(feats: DataFrame, grains=None) -> DataFrame:
    """Mean and sample std (0 for one value) per run, grain and key over the training events.

    One GROUPING SETS aggregation covers all grains. The result is the saved model: it is stored, so that applying
    it does not aggregate again.
    """
    grains = usable_grains(feats, grains)
    runs = ["run"] if "run" in feats.columns else []
    train = _filled(feats).where(F.col("split") == "train").select(*runs, *KEY_COLUMNS, "delta_t", "cum_t")
    sets = [[F.col(c) for c in runs + GRAINS[g][0]] for g in grains]
    stats = train.groupingSets(sets, *runs, *KEY_COLUMNS).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
        *[f(v).alias(f"{n}_{v}") for v in ("delta_t", "cum_t")
          for n, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))])
    grain, mean, std = F.lit(None).cast("string"), F.col("mean_delta_t"), F.col("std_delta_t")
    for g in grains:
        keys = GRAINS[g][0]
        gid = int("".join("0" if c in runs + keys else "1" for c in runs + KEY_COLUMNS), 2)
        grain = F.when(F.col("gid") == gid, g).otherwise(grain)
    mean = F.when(grain == "cum_t", F.col("mean_cum_t")).otherwise(mean)
    std = F.when(grain == "cum_t", F.col("std_cum_t")).otherwise(std)
    return scale.materialise(stats.select(*runs, grain.alias("grain"), *KEY_COLUMNS, "n",
                                          mean.alias("mean"), std.alias("std")))


def apply_context_stats(feats: DataFrame, stats: DataFrame, grains=None) -> DataFrame:
    """Add expected_* and z_score_* per grain; a key unseen in training has mean and std 0.

    Each grain is one left join, broadcast when its table is small, so usually no shuffle at all. Logs without
    resource get 0.0 for the resource grains.
    """
    wanted = list(GRAINS if grains is None else grains)
    usable = usable_grains(feats, wanted)
    runs = ["run"] if "run" in feats.columns else []
    total = stats.count()
    sizes = dict.fromkeys(usable, total)
    if total > scale.BROADCAST_ROWS:
        sizes = {r["grain"]: r["count"] for r in stats.groupBy("grain").count().collect()}
    out = base = _filled(feats)
    for g in wanted:
        keys, value, expected, z = GRAINS[g]
        if g not in usable:
            out = out.withColumns({f"expected_{expected}": F.lit(0.0), f"z_score_{z}": F.lit(0.0)})
            continue
        table = stats.where(F.col("grain") == g).select(*runs, *keys, F.col("mean").alias("_m"),
                                                        F.col("std").alias("_s"))
        out = scale.lookup_join(out, table, [*runs, *keys], sizes.get(g, 0), base=base)
        mean, std = F.coalesce("_m", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))
        out = out.withColumns({f"expected_{expected}": mean,
                               f"z_score_{z}": S.z_score(F.col(value), mean, std)}).drop("_m", "_s")
    return out


def workload_steps(feats: DataFrame, hours: int = 2) -> DataFrame:
    """The sweep behind ``resource_workload``: every event arrives (+1) and, ``hours`` later, departs (-1).

    ``_at`` and ``_arrives`` order the steps: at equal times departures come first. Departures carry the keys alone.
    """
    keys = ["run"] if "run" in feats.columns else []
    steps = _filled(feats).withColumn("_arrives", F.explode(F.array(F.lit(0), F.lit(1))))
    late = F.when(F.col("_arrives") == 0, F.lit(hours * 3_600_000_000)).otherwise(F.lit(0))
    kept = {*keys, "resource", "event_key"}
    return steps.select(
        *[F.col(c) if c in kept else F.when(F.col("_arrives") == 1, F.col(c)).alias(c) for c in feats.columns],
        (F.col("time_us") + late).alias("_at"), "_arrives")


def resource_workload(feats: DataFrame, hours: int = 2, limit: int = scale.HOT_ROWS) -> DataFrame:
    """Add ``resource_workload``: events of the resource in the trailing (t - hours, t], the event included.

    Of events at the same time only those up to the present one in (time_us, event_key) order count. The count is the
    running sum of arrivals and departures of the resource; resources of more than ``limit`` steps are summed in range
    segments over many tasks, however their events lie in time, so no hour of a busy resource is gathered in one task.
    """
    if not has_resource(feats):
        return feats.withColumn("resource_workload", F.lit(0.0))
    keys = ["run"] if "run" in feats.columns else []
    steps = workload_steps(feats, hours)
    change = (F.col("_arrives") * 2 - 1).cast("bigint")
    out = scale.running(steps, [*keys, "resource"], ["_at", "_arrives", "event_key"], {"_load": change}, limit,
                        2 * feats.count())
    return out.where("_arrives = 1").select(*feats.columns, F.col("_load").cast("double").alias("resource_workload"))


def context_features(feats: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """All context features; the statistics are fitted on the log's own training events unless given.

    The features are stored first: workload and statistics read them several times.
    """
    feats = scale.materialise(feats)
    return apply_context_stats(resource_workload(feats), fit_context_stats(feats) if stats is None else stats)
