"""Choosing configurations and comparing them with a published baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inject import RATE
from .levels import FEATURE_SETS
from .profile import LEVELS
from ..functions import scalars as S

CANDIDATE = "IsolationForest"
# Configurations compared on all datasets, by label.
FIXED_CONFIGS = {
    "5. Fixed Config Cyclical": (CANDIDATE, "L3_Global", "pure_cyclical"),
    "6. Fixed Config DT+Cyclical": (CANDIDATE, "L3_Global", "delta_cyclical"),
}
ORACLE, UNSUPERVISED = "2. Oracle (Local F1)", "3. Unsupervised (Local GMM Separation)"
BASELINE = "1. Autoencoder"
# Class, metric, metric column.
METRIC_MAP = [
    ("Normal", "Precision", "precision_normal_mean"),
    ("Normal", "Recall", "recall_normal_mean"),
    ("Normal", "F1-Score", "f1_score_normal_mean"),
    ("Anomalous", "Precision", "precision_anomalous_mean"),
    ("Anomalous", "Recall", "recall_anomalous_mean"),
    ("Anomalous", "F1-Score", "f1_score_anomalous_mean"),
    ("Average", "Precision", "average_precision"),
    ("Average", "Recall", "average_recall"),
    ("Average", "F1-Score", "average_f1"),
]
# Published results of the autoencoder baseline, in the order of METRIC_MAP.
BASELINE_SCORES = {
    "bpi_2012": [0.92, 0.61, 0.73, 0.11, 0.47, 0.18, 0.839, 0.596, 0.675],
    "bpi_2013": [0.93, 0.65, 0.77, 0.16, 0.58, 0.25, 0.853, 0.643, 0.718],
    "small_log": [0.97, 0.99, 0.98, 0.92, 0.69, 0.78, 0.965, 0.963, 0.962],
    "large_log": [0.97, 0.99, 0.98, 0.82, 0.71, 0.76, 0.955, 0.962, 0.958],
}
# Chart titles of the metrics and the order of models.
CHART_METRICS = {
    "f1_score_anomalous_mean": "F1-Score (Anomalies)",
    "precision_anomalous_mean": "Precision (Anomalies)",
    "recall_anomalous_mean": "Recall (Anomalies)",
    "f1_score_normal_mean": "F1-Score (Normal)",
    "precision_normal_mean": "Precision (Normal)",
    "recall_normal_mean": "Recall (Normal)",
    "predicted_anomaly_rate_mean": "Predicted Anomaly Rate (%)",
}
MODEL_ORDER = ["IsolationForest", "LOF", "DBSCAN"]


def candidates(table: DataFrame, model: str = CANDIDATE) -> DataFrame:
    """Rows of one model above the finest level, with the cleaned dataset name."""
    rows = table.where((F.col("model") == model) & (F.col("level") != "L1_Micro"))
    return rows.withColumn("ds_clean", S.dataset_label(F.col("dataset")))


def average_metrics(table: DataFrame, rate: float = RATE) -> DataFrame:
    """Class-weighted average precision, recall and F1: anomalies weigh ``rate``."""
    def mixed(m):
        return F.col(f"{m}_normal_mean") * F.lit(1 - rate) + F.col(f"{m}_anomalous_mean") * F.lit(rate)

    return table.withColumns({"average_precision": mixed("precision"), "average_recall": mixed("recall"),
                              "average_f1": mixed("f1_score")})


def select_best(table: DataFrame, by: str) -> DataFrame:
    """Per dataset the configuration with the largest value; ties go to the first in model, level, feature set order."""
    w = Window.partitionBy("ds_clean").orderBy(F.col(by).desc_nulls_last(), "model", "level", "feature_set")
    return table.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def select_fixed(table: DataFrame, config: tuple[str, str, str]) -> DataFrame:
    model, level, feature_set = config
    return table.where((F.col("model") == model) & (F.col("level") == level)
                       & (F.col("feature_set") == feature_set))


def approaches(table: DataFrame, fixed: dict = FIXED_CONFIGS) -> dict[str, DataFrame]:
    """The selections by label, from candidate rows with average metrics."""
    out = {ORACLE: select_best(table, "f1_score_anomalous_mean"), UNSUPERVISED: select_best(table, "separation_score")}
    for name, config in fixed.items():
        out[config_text(name, config)] = select_fixed(table, config)
    return out


def config_text(name: str, config: tuple[str, str, str] | None) -> str:
    return name if config is None else f"{name} ({config[0]} | {config[1]} | {config[2]})"


def metric_rows(table: DataFrame) -> DataFrame:
    """One row per class and metric: the nine metric columns turned into rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric"), F.lit(i).alias("ord"),
                                 F.col(col).alias("score")) for i, (c, m, col) in enumerate(METRIC_MAP)])
    keep = [c for c in ("ds_clean", "approach") if c in table.columns]
    return table.select(*keep, F.explode(entries).alias("_m")).select(*keep, "_m.*")


def baseline_table(spark: SparkSession, scores: dict = BASELINE_SCORES) -> DataFrame:
    rows = [(ds, BASELINE, c, m, i, v[i]) for ds, v in scores.items() for i, (c, m, _) in enumerate(METRIC_MAP)]
    return spark.createDataFrame(rows, "ds_clean string, approach string, class string, metric string, ord int, "
                                       "score double")


def comparison_long(selections: dict[str, DataFrame], baseline: DataFrame) -> DataFrame:
    """Baseline and selections as rows dataset, class, metric, approach, score, for the datasets of the baseline."""
    rows = reduce(DataFrame.unionByName,
                  [metric_rows(df.withColumn("approach", F.lit(name))) for name, df in selections.items()])
    # The baseline has nine rows per dataset; it is a table of constants.
    known = F.broadcast(baseline.select("ds_clean").distinct())
    return baseline.unionByName(rows.join(known, "ds_clean", "left_semi").select(*baseline.columns))


def comparison_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column of three-decimal text per approach; a missing approach stays null."""
    text = F.first(S.three_decimals(F.col("score")))
    return long.groupBy("ds_clean", "class", "metric", "ord").pivot("approach", names).agg(text)


def selection_labels(datasets: DataFrame, unsupervised: DataFrame, oracle: DataFrame) -> DataFrame:
    """Per dataset its name and, on further lines, level and feature set of both selections."""
    def part(df, title, name):
        level = F.element_at(F.split("level", "_"), 1)
        return df.select("ds_clean", F.format_string(f"[{title}: %s | %s]", level, F.col("feature_set")).alias(name))

    joined = (datasets.select("ds_clean").distinct()
              .join(part(unsupervised, "GMM", "_u"), "ds_clean", "left")
              .join(part(oracle, "Oracle", "_o"), "ds_clean", "left"))
    return joined.select("ds_clean", F.concat_ws("\n", "ds_clean", "_u", "_o").alias("label"))


def chart_ready(table: DataFrame, levels=LEVELS, feature_sets=tuple(FEATURE_SETS), models=tuple(MODEL_ORDER)) -> DataFrame:
    """Metric values as rows with chart titles and the explicit order of level, feature set and model."""
    def place(column, values):
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int")

    rows = table.where(F.col("level").isin(list(levels)) & F.col("feature_set").isin(list(feature_sets)))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("title"), F.col(m).alias("value"))
                        for m, t in CHART_METRICS.items() if m in table.columns])
    ids = ["dataset", "model", "level", "feature_set"]
    rows = rows.select(*ids, F.explode(entries).alias("_m")).select(*ids, "_m.*")
    return rows.withColumns({"level_ord": place("level", levels), "feature_ord": place("feature_set", feature_sets),
                             "model_ord": place("model", models)})
