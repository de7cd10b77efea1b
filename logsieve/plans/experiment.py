"""The whole experiment: log -> split -> injected runs -> features -> scores -> limits -> metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import fixture
from ..operators import compare, density, evaluate, forest, levels, profile, scale
from ..operators.context import apply_context_stats, fit_context_stats, resource_workload
from ..operators.features import base_features
from ..operators.inject import RATE, inject_anomalies
from ..operators.order import order_events
from ..operators.split import split
from ..operators.thresholds import IQR_MULTIPLIERS, exceeded, gmm_limits, iqr_limits, predict
from ..sources.readers import read_event_log
from ..sources.sinks import wide_scores, write_log_once, write_report, write_scores
from ..sources.spec import DATASETS, EventLogSpec, to_canonical

RUNS = tuple(range(1, 11))
DETECTORS = ("IsolationForest", "LOF", "DBSCAN")


def prepare(raw: DataFrame, spec: EventLogSpec, runs=RUNS, rate: float = RATE, seed: int = 7) -> DataFrame:
    """Canonical, ordered, split and injected log with a run column. ``raw`` may be canonical already."""
    log = raw if "event_key" in raw.columns and "time_us" in raw.columns else to_canonical(raw, spec)
    log = scale.materialise(order_events(log))
    return inject_anomalies(split(log, spec.split_mode), rate, runs, seed)


def features(prepared: DataFrame) -> DataFrame:
    """All features of a prepared log; stored once the statistics are fitted, since every detector reads them."""
    base = scale.materialise(resource_workload(base_features(prepared)))
    return apply_context_stats(base, fit_context_stats(base))


def score(feats: DataFrame, feature_sets: dict = levels.FEATURE_SETS, which=levels.LEVELS, detectors=DETECTORS,
          jitter: bool = True, seed: int = 7,
          min_samples: int = levels.MIN_SAMPLES) -> DataFrame:
    """Long score table of all detectors: run, group, event_key, split, truth, model, feature_set, score.

    Events of groups too small to fit a detector are kept with a null score, since evaluation counts them as not
    predicted. ``jitter`` adds the tiny noise that tells equal vectors apart, drawn anew for fitting and scoring.
    """
    keep = [*levels.run_keys(feats), *levels.GROUP, "event_key", "split", "is_true_anomaly"]
    names = levels.features_of(feature_sets)
    grouped = levels.with_levels(feats, which).select(*keep, *names)
    grouped = scale.materialise(grouped)
    ranges = scale.materialise(levels.group_ranges(grouped, feature_sets))
    usable, groups = levels.usable_groups(ranges, min_samples), ranges.count()

    def scaled(draw):
        return levels.scaled_features(grouped, usable, feature_sets, draw if jitter else None, seed,
                                      groups)

    rows = scale.materialise(scaled("score"))
    fit_rows = scaled("fit") if jitter else rows
    columns = [*keep, "model", "feature_set", "score"]
    out = []
    if "IsolationForest" in detectors:
        model = forest.iforest_fit(fit_rows, feature_sets, seed=seed)
        out.append(forest.iforest_score(rows, model, feature_sets).select(*columns))
    if "LOF" in detectors or "DBSCAN" in detectors:
        vectors = scale.materialise(levels.feature_vectors(rows, feature_sets).select(*keep, "feature_set", "x"))
        if "LOF" in detectors:
            fit = None
            if jitter:
                fit = levels.feature_vectors(fit_rows.where(F.col("split") == "train"), feature_sets)
                fit = fit.select(*keep, "feature_set", "x")
            out.append(density.lof(vectors, fit).select(*columns))
        if "DBSCAN" in detectors:
            out.append(density.dbscan_noise(vectors).select(*columns))
    scores = reduce(DataFrame.unionByName, out)

    small = scale.lookup_join(grouped.select(*keep), usable.withColumn("_in", F.lit(True))
                              .select(*levels.group_keys(grouped), "_in"), levels.group_keys(grouped), groups)
    small = small.where(F.col("_in").isNull()).drop("_in")
    combos = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(fs).alias("feature_set"))
                       for m in detectors for fs in feature_sets])
    small = small.withColumn("_c", F.explode(combos)).select(*keep, "_c.*").withColumn("score", F.lit(None).cast("double"))
    return scores.unionByName(small.select(*columns))


def metrics_table(scores: DataFrame, feature_sets=tuple(levels.FEATURE_SETS), limits: str = "gmm",
                  multipliers=None) -> DataFrame:
    """Metrics per run and configuration of a stored score table, with mixture (``gmm``) or ``iqr`` limits."""
    if limits == "gmm":
        found = gmm_limits(scores)
    else:
        found = iqr_limits(scores.where(F.col("model") != "DBSCAN"), multipliers)
    found = scale.materialise(found)
    if "multiplier" not in found.columns:
        return evaluate.evaluate(scores, found, predict(scores, found), feature_sets)
    every = [float(m) for m in (IQR_MULTIPLIERS if multipliers is None else multipliers)]
    groups = evaluate.sweep_confusion(exceeded(scores, found, every), found, every)
    return evaluate.evaluate_groups(scores, found, groups, feature_sets)


def generate_and_score(spark: SparkSession, raw_dir: str, work_dir: str, datasets: dict = DATASETS, runs=RUNS,
                       bad: str = "fail", **options) -> list[str]:
    """Score every dataset found under ``raw_dir``; prepared logs are stored and reused. Returns the datasets done."""
    done = []
    for name, spec in datasets.items():
        log = read_event_log(spark, f"{raw_dir}/{name}", spec, bad)
        if log is None:
            continue
        label = name.replace(".csv", "")
        prepared = write_log_once(spark, f"{work_dir}/prepared", label, list(runs),
                                  lambda r, log=log, spec=spec: prepare(log, spec, r))
        scores = score(features(prepared), **options)
        write_scores(scores.withColumn("dataset", F.lit(label)), f"{work_dir}/scores")
        done.append(name)
    return done


def evaluate_scores(scores: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Metrics over runs of a stored score table; written as a report when a path is given."""
    table = scale.materialise(evaluate.over_runs(metrics_table(scores, **options)))
    if path:
        write_report(table.orderBy("dataset", "model", "level", "feature_set"), path)
    return table


def generate_comparison(table: DataFrame, baseline: dict = compare.BASELINE_SCORES, path: str | None = None) -> DataFrame:
    """The wide comparison of selections and baseline, from metrics over runs."""
    spark = table.sparkSession
    picked = compare.average_metrics(compare.candidates(table))
    selections = compare.approaches(picked)
    long = compare.comparison_long(selections, compare.baseline_table(spark, baseline))
    wide = compare.comparison_wide(long, [compare.BASELINE, *selections])
    if path:
        write_report(wide.orderBy("ds_clean", "ord").drop("ord"), path)
    return wide


def write_comparison(table: DataFrame, folder: str, baseline: dict = compare.BASELINE_SCORES) -> None:
    """The comparison's reports: the wide and the long table, the chosen configurations as labels, and the chart table."""
    generate_comparison(table, baseline, f"{folder}/wide")
    spark = table.sparkSession
    selections = compare.approaches(compare.average_metrics(compare.candidates(table)))
    rows = compare.baseline_table(spark, baseline)
    write_report(compare.comparison_long(selections, rows).orderBy("ds_clean", "ord", "approach").drop("ord"), f"{folder}/long")
    names = list(selections)
    labels = compare.selection_labels(rows, selections[names[1]], selections[names[0]])
    write_report(labels.orderBy("ds_clean"), f"{folder}/labels")
    chart = compare.chart_ready(table).orderBy("dataset", "metric", "level_ord", "feature_ord", "model_ord")
    write_report(chart, f"{folder}/chart")


def write_wide_scores(scores: DataFrame, root: str) -> None:
    """Stored long scores in the wide layout, a column per configuration, partitioned by dataset and run."""
    found = scores.select("model", "level", "feature_set").distinct().orderBy("model", "level", "feature_set").collect()
    ids = [c for c in ("dataset", "run", "event_key", "split", "is_true_anomaly") if c in scores.columns]
    wide = wide_scores(scores, ids, [tuple(c) for c in found])
    (wide.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*[c for c in ("dataset", "run") if c in ids]).parquet(root))


def analyze_datasets(spark: SparkSession, raw_dir: str, path: str | None = None, datasets: dict = DATASETS,
                     bad: str = "fail") -> DataFrame | None:
    """The rounded profile of every dataset found under ``raw_dir``, stored as one report; None when there is none."""
    tables = []
    for name, spec in datasets.items():
        log = read_event_log(spark, f"{raw_dir}/{name}", spec, bad)
        if log is not None:
            table = profile.rounded_profile(profile.profile(scale.materialise(log)))
            tables.append(table.select(F.lit(name.replace(".csv", "")).alias("dataset"), "*"))
    if not tables:
        return None
    out = scale.materialise(reduce(DataFrame.unionByName, tables))
    if path:
        write_report(out.orderBy("dataset", F.col("level").desc()), path)
    return out


def click_experiment(spark: SparkSession, sf_dir: str, runs=(1, 2), detectors=("IsolationForest",)) -> DataFrame:
    """The experiment on the click log, up to metrics over runs."""
    spec = EventLogSpec("case_id", "activity", "time", "resource", "event_key")
    prepared = prepare(fixture(spark, sf_dir, "clicks"), spec, runs)
    scores = scale.materialise(score(features(prepared), detectors=detectors))
    return evaluate.over_runs(metrics_table(scores))
