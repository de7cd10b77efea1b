"""Grouping levels, feature sets and train-range scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scale
from .profile import LEVELS, MIN_SAMPLES
from ..functions import scalars as S
from ..sources.spec import has_resource

# The named feature sets.
FEATURE_SETS = {
    "delta_t": ["delta_t"],
    "delta_z_micro": ["delta_t", "z_score_micro"],
    "cum_z_cum_t": ["cum_t", "z_score_cum_t"],
    "pure_cyclical": ["hour_sin", "hour_cos", "day_sin", "day_cos"],
    "delta_cyclical": ["delta_t", "hour_sin", "hour_cos", "day_sin", "day_cos"],
    "omni_fusion_cyclical": ["delta_t", "cum_t", "z_score_micro", "z_score_transition", "z_score_cum_t",
                             "resource_workload", "hour_sin", "hour_cos", "day_sin", "day_cos"],
}
# Columns that name a group: level, and its activity and resource ('' where the level has none).
GROUP = ["level", "g_act", "g_res"]


def run_keys(df: DataFrame) -> list[str]:
    return [c for c in ("dataset", "run") if c in df.columns]


def group_keys(df: DataFrame) -> list[str]:
    return run_keys(df) + GROUP


def with_levels(rows: DataFrame, levels=LEVELS) -> DataFrame:
    """Repeat every event once per level with the group it belongs to; L1 needs a resource."""
    activity = F.coalesce("activity", F.lit("0"))
    resource = F.coalesce("resource", F.lit("0"))
    none = F.lit("")
    names = {"L3_Global": (none, none), "L2_Activity": (activity, none), "L1_Micro": (activity, resource)}
    levels = [lv for lv in levels if lv != "L1_Micro" or has_resource(rows)]
    entries = [F.struct(F.lit(lv).alias("level"), names[lv][0].alias("g_act"), names[lv][1].alias("g_res"))
               for lv in levels]
    return rows.withColumn("_g", F.explode(F.array(*entries))).select("*", "_g.*").drop("_g")


def features_of(feature_sets: dict) -> list[str]:
    return list(dict.fromkeys(c for cols in feature_sets.values() for c in cols))


def group_ranges(grouped: DataFrame, feature_sets: dict = FEATURE_SETS) -> DataFrame:
    """Per group: events, training events, and the training minimum and range of every feature (float32).

    Groups without training events have null ranges. Partially aggregated before the shuffle.
    """
    train = F.col("split") == "train"
    aggs = []
    for c in features_of(feature_sets):
        value = F.when(train, F.col(c).cast("float"))
        aggs += [F.min(value).alias(f"lo_{c}"), (F.max(value) - F.min(value)).alias(f"ptp_{c}")]
    return grouped.groupBy(*group_keys(grouped)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(train).alias("n_train"), *aggs)


def usable_groups(ranges: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Groups a detector is fitted for: enough training events; the global level needs only one."""
    enough = (F.col("n_train") >= min_samples) | ((F.col("level") == "L3_Global") & (F.col("n_train") > 0))
    return ranges.where(enough)


def scaled_features(grouped: DataFrame, ranges: DataFrame, feature_sets: dict = FEATURE_SETS,
                    jitter: str | None = None, seed: int = 7, groups: int | None = None) -> DataFrame:
    """Replace the features by (x - train minimum) / (train range + 1e-8) as float32; drops groups not in ``ranges``.

    n and n_train of the group come along. ``groups`` is the size of a stored ``ranges``.

    ``jitter`` names a noise draw of N(0, 1e-6) added per row, level and feature; None adds none.
    """
    keys = group_keys(grouped)
    rows = scale.lookup_join(grouped, ranges.withColumn("_in", F.lit(True)), keys, groups)
    rows = rows.where(F.col("_in"))
    out = {}
    for c in features_of(feature_sets):
        x = F.col(c).cast("float").cast("double")
        x = (x - F.col(f"lo_{c}").cast("double")) / (F.col(f"ptp_{c}").cast("double") + F.lit(1e-8))
        if jitter:
            run = F.col("run") if "run" in grouped.columns else F.lit(0)
            key = F.concat_ws("|", F.col("event_key"), F.col("level"))
            x = x + F.lit(1e-6) * S.normal(f"{jitter}|{c}", seed, run, key)
        out[c] = x.cast("float")
    rows = rows.withColumns(out)
    return rows.drop("_in", *[f"{p}_{c}" for c in out for p in ("lo", "ptp")])


def feature_vectors(rows: DataFrame, feature_sets: dict = FEATURE_SETS) -> DataFrame:
    """Repeat every row once per feature set with its vector ``x``."""
    entries = [F.struct(F.lit(name).alias("feature_set"),
                        F.array(*[F.col(c).cast("float") for c in cols]).alias("x"))
               for name, cols in feature_sets.items()]
    keep = [c for c in rows.columns if c not in features_of(feature_sets)]
    return rows.select(*keep, F.explode(F.array(*entries)).alias("_v")).select(*keep, "_v.*")
