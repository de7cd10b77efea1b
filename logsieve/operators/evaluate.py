"""Confusion matrices, metrics and their averages over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scale
from .levels import FEATURE_SETS, run_keys
from .thresholds import limit_sweeps, score_keys
from ..functions.scalars import ratio

# The metrics averaged over runs.
METRICS = ["predicted_anomaly_rate", "precision_anomalous", "recall_anomalous", "f1_score_anomalous",
           "precision_normal", "recall_normal", "f1_score_normal"]
COUNTS = ["tp", "fp", "fn", "tn"]


def config_keys(df: DataFrame) -> list[str]:
    return [*run_keys(df), "model", "level", "feature_set", *[c for c in ["multiplier"] if c in df.columns]]


def eligible_groups(scores: DataFrame) -> DataFrame:
    """Keys with at least one validation and one test row; the others count nowhere."""
    keys = score_keys(scores)
    facts = scores.groupBy(*keys).agg(F.count_if(F.col("split") == "val").alias("n_val"),
                                      F.count_if(F.col("split") == "test").alias("n_test"))
    return facts.where((F.col("n_val") > 0) & (F.col("n_test") > 0))


def group_confusion(predicted: DataFrame) -> DataFrame:
    """tp, fp, fn, tn over the test rows of every eligible key, from one aggregation."""
    keys = list(dict.fromkeys([*score_keys(predicted), *config_keys(predicted)]))
    test = F.col("split") == "test"
    truth, said = F.col("is_true_anomaly") == 1, F.col("predicted") == 1
    cells = {"tp": truth & said, "fp": ~truth & said, "fn": truth & ~said, "tn": ~truth & ~said}
    counted = predicted.groupBy(*keys).agg(
        F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(test).alias("n_test"),
        *[F.count_if(test & c).alias(n) for n, c in cells.items()])
    return counted.where((F.col("n_val") > 0) & (F.col("n_test") > 0)).drop("n_val", "n_test")


def sweep_confusion(ranked: DataFrame, limits: DataFrame, multipliers: list[float]) -> DataFrame:
    """``group_confusion`` for every multiplier from rows that carry how many limits they exceed.

    Test rows are counted once per (key, exceeded, truth), which is at most one number more than there are multipliers; sums
    over the higher ranks give the cells of each limit.
    """
    keys = score_keys(ranked)
    test, truth = F.col("split") == "test", F.col("is_true_anomaly") == 1
    ranks = ranked.groupBy(*keys, "exceeded").agg(
        F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(test & truth).alias("n_true"),
        F.count_if(test & ~truth).alias("n_false"))
    groups = ranks.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_val", "n_true", "n_false")],
        F.collect_list(F.struct("exceeded", "n_true", "n_false")).alias("_ranks"))
    groups = scale.lookup_join(groups.where("n_val > 0 AND n_true + n_false > 0"), limit_sweeps(limits), keys)
    order = F.transform("sweep", lambda x: x["multiplier"])
    any_order = F.array(*[F.lit(float(m)) for m in multipliers])
    rows = groups.select(*keys, "n_true", "n_false", "_ranks", F.posexplode(F.coalesce(order, any_order)).alias("_at", "multiplier"))

    def above(cell):
        higher = F.filter("_ranks", lambda x: x["exceeded"] > F.col("_at"))
        return F.aggregate(higher, F.lit(0).cast("bigint"), lambda acc, x: acc + x[cell])

    return rows.withColumns({"tp": above("n_true"), "fp": above("n_false")}).select(
        *list(dict.fromkeys([*keys, *config_keys(rows)])), "tp", "fp", (F.col("n_true") - F.col("tp")).alias("fn"),
        (F.col("n_false") - F.col("fp")).alias("tn"))


def confusion(predicted: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per run and configuration, summed over the eligible groups."""
    return confusion_of_groups(group_confusion(predicted))


def confusion_of_groups(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*config_keys(cells)).agg(*[F.sum(c).alias(c) for c in COUNTS])


def threshold_summary(groups: DataFrame, limits: DataFrame) -> DataFrame:
    """Mean limit and separation over the eligible groups per run and configuration.

    A group without limit (no scored validation row) takes part with 0. DBSCAN has no limit, and separation 0.
    """
    both = [c for c in ("multiplier",) if c in groups.columns and c in limits.columns]
    joined = groups.join(limits, [*score_keys(groups), *both], "left")
    dbscan = F.col("model") == "DBSCAN"
    return joined.groupBy(*config_keys(joined)).agg(
        F.avg(F.when(~dbscan, F.coalesce("threshold_value", F.lit(0.0)))).alias("threshold_value"),
        F.avg(F.when(dbscan, 0.0).otherwise(F.coalesce("separation_score", F.lit(0.0)))).alias("separation_score"))


def metrics(cm: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes and the predicted anomaly rate; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    out = cm.withColumns({
        "predicted_anomaly_rate": ratio(tp + fp, tp + fp + fn + tn) * 100,
        "precision_anomalous": ratio(tp, tp + fp), "recall_anomalous": ratio(tp, tp + fn),
        "precision_normal": ratio(tn, tn + fn), "recall_normal": ratio(tn, tn + fp)})
    for c in ("anomalous", "normal"):
        p, r = F.col(f"precision_{c}"), F.col(f"recall_{c}")
        out = out.withColumn(f"f1_score_{c}", ratio(2 * p * r, p + r))
    return out


def evaluate(scores: DataFrame, limits: DataFrame, predicted: DataFrame, feature_sets=tuple(FEATURE_SETS)) -> DataFrame:
    """One metric row per run and configuration.

    A feature set without any eligible score still gets a row, all zero, when its run, model and level has scores.
    """
    return evaluate_groups(scores, limits, group_confusion(predicted), feature_sets)


def evaluate_groups(scores: DataFrame, limits: DataFrame, groups: DataFrame, feature_sets=tuple(FEATURE_SETS)) -> DataFrame:
    """``evaluate`` from the cells of every group."""
    groups = scale.materialise(groups)
    keys = config_keys(groups)
    cm = groups.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    summary = threshold_summary(groups.drop(*COUNTS), limits)
    others = [k for k in keys if k != "feature_set"]
    grid = (scores.select(*[k for k in others if k != "multiplier"]).distinct()
            .withColumn("feature_set", F.explode(F.array(*[F.lit(f) for f in feature_sets]))))
    if "multiplier" in others:
        grid = grid.withColumn("multiplier", F.explode(F.array(*[
            F.lit(r[0]) for r in limits.select("multiplier").distinct().orderBy("multiplier").collect()])))
    out = grid.join(cm, keys, "left").join(summary, keys, "left")
    dbscan = F.col("model") == "DBSCAN"
    return metrics(out.select(
        *keys, F.when(~dbscan, F.coalesce("threshold_value", F.lit(0.0))).alias("threshold_value"),
        F.coalesce("separation_score", F.lit(0.0)).alias("separation_score"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]))


def over_runs(table: DataFrame) -> DataFrame:
    """Mean and sample std of every metric over the runs of a configuration; the std of one run is null."""
    keys = [k for k in config_keys(table) if k != "run"]
    aggs = [F.avg("threshold_value").alias("threshold_value_mean"), F.avg("separation_score").alias("separation_score")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return table.groupBy(*keys).agg(*aggs)
