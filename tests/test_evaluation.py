import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import compare, evaluate, thresholds

SCHEMA = ("run int, level string, g_act string, g_res string, model string, feature_set string, event_key string, "
          "split string, is_true_anomaly int, score double")


def rows_of(group, val, test, model="M", fs="f", run=1):
    out = [(run, "L2_Activity", group, "", model, fs, f"v{i}", "val", 0, s) for i, s in enumerate(val)]
    return out + [(run, "L2_Activity", group, "", model, fs, f"t{i}", "test", y, s) for i, (y, s) in enumerate(test)]


def limits_of(spark, *groups, **kw):
    df = spark.createDataFrame([r for g in groups for r in g], SCHEMA)
    return df, thresholds.gmm_limits(df, **kw)


def brute_em(x, weight, mean, var, steps=100):
    last = -np.inf
    for _ in range(steps):
        p = weight[:, None] * np.exp(-(x - mean[:, None]) ** 2 / (2 * var[:, None])) / np.sqrt(2 * np.pi * var[:, None])
        bound = np.log(p.sum(axis=0)).mean()
        if abs(bound - last) < 1e-3:
            break
        last = bound
        r = p / p.sum(axis=0)
        n = r.sum(axis=1)
        mean = (r * x).sum(axis=1) / n
        var = (r * (x - mean[:, None]) ** 2).sum(axis=1) / n + 1e-6
        weight = n / n.sum()
    return weight, mean, var


def test_mixture_equals_plain_em(spark):
    rng = np.random.default_rng(3)
    x = np.sort(np.concatenate([rng.normal(0.4, 0.05, 300), rng.normal(0.8, 0.1, 60)]))
    at = thresholds.two_means(x, np.ones(len(x)))
    costs = [x[:i].var() * i + x[i:].var() * (len(x) - i) for i in range(1, len(x))]
    assert at == int(np.argmin(costs)) + 1
    start = (np.array([at, len(x) - at]) / len(x), np.array([x[:at].mean(), x[at:].mean()]),
             np.array([x[:at].var() + 1e-6, x[at:].var() + 1e-6]))
    want = brute_em(x, *start)
    df, _ = limits_of(spark, rows_of("g", x.tolist(), [(0, 0.5)]))
    row = thresholds.gmm_components(df).first()
    got = [[row["w0"], row["w1"]], [row["mu0"], row["mu1"]], [row["var0"], row["var1"]]]
    assert np.allclose(got, want, rtol=1e-6)
    limit = thresholds.limits_from_components(thresholds.gmm_components(df)).first()
    grid = np.linspace(x.min(), x.max(), 1000)
    p = want[0][:, None] * np.exp(-(grid - want[1][:, None]) ** 2 / (2 * want[2][:, None])) / np.sqrt(want[2][:, None])
    assert limit["threshold_value"] == pytest.approx(grid[np.argmax(p[1] / p.sum(axis=0) >= 0.5)])
    assert limit["separation_score"] == pytest.approx(abs(want[1][0] - want[1][1]) / np.sqrt(want[2]).sum(), rel=1e-6)


def test_mixtures_fitted_by_aggregations_equal_those_fitted_in_one_task(spark):
    rng = np.random.default_rng(8)
    groups = [rows_of("two", np.concatenate([rng.normal(0.4, 0.05, 900), rng.normal(0.8, 0.1, 200)]).tolist(), []),
              rows_of("long", rng.lognormal(0, 1.5, 700).round(2).tolist(), []),
              rows_of("far", (1e6 + rng.normal(size=300)).tolist() + rng.normal(size=500).tolist(), []),
              rows_of("few", [5.0, 1.0, 2.0, 9.0], []), rows_of("flat", [0.7] * 300, [])]
    df, _ = limits_of(spark, *groups)
    one, many = ({r["g_act"]: r for r in thresholds.gmm_components(df, n).collect()} for n in (65_536, 50))
    assert set(one) == set(many) == {"two", "long", "far", "few", "flat"}
    for g, want in one.items():
        for c in ("n", "mean", "mid", "lo", "hi", *thresholds._PARAMS):
            assert want[c] == many[g][c] or many[g][c] == pytest.approx(want[c], rel=1e-6), (g, c)
    limits = [{r["g_act"]: r["threshold_value"] for r in thresholds.gmm_limits(df, n).collect()} for n in (65_536, 50)]
    assert limits[0] == pytest.approx(limits[1], rel=1e-6)


def test_fallback_limits(spark):
    _, limits = limits_of(spark, rows_of("few", [5.0, 1.0, 2.0, 9.0], []), rows_of("flat", [0.7] * 10, []),
                          rows_of("none", [None, None], []))
    got = {r["g_act"]: (r["threshold_value"], r["separation_score"]) for r in limits.collect()}
    assert got == {"few": (3.5, 0.0), "flat": (0.7, 0.0)}


def test_quantiles_in_segments(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 90, 1000)
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("one", 4.0)], "k string, v double")
    for limit in (2_000_000, 30):
        got = {r["k"]: r for r in thresholds.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}, limit).collect()}
        assert got["k"]["a"] == np.quantile(x, 0.25) and got["k"]["b"] == pytest.approx(np.quantile(x, 0.9))
        assert got["one"]["a"] == got["one"]["b"] == 4.0


def table(spark):
    a = rows_of("a", [0.1] * 4, [(1, 0.9), (0, 0.8), (1, 0.05), (0, 0.05), (0, None)])
    unscored = rows_of("u", [None, None], [(1, None), (0, None)])
    no_val = rows_of("n", [], [(1, 0.9)])
    flags = rows_of("a", [0.0], [(1, 1.0), (0, 0.0)], model="DBSCAN")
    return spark.createDataFrame(a + unscored + no_val + flags, SCHEMA)


def test_confusion_counts_unscored_groups_and_leaves_out_groups_without_validation(spark):
    df = table(spark)
    limits = thresholds.gmm_limits(df)
    predicted = thresholds.predict(df, limits)
    cm = {r["model"]: [r[c] for c in evaluate.COUNTS] for r in evaluate.confusion(predicted).collect()}
    assert cm == {"M": [1, 1, 2, 3], "DBSCAN": [1, 0, 0, 1]}
    assert evaluate.eligible_groups(df).count() == 3
    out = evaluate.evaluate(df, limits, predicted, ["f", "absent"]).collect()
    got = {(r["model"], r["feature_set"]): r for r in out}
    m = got["M", "f"]
    # The unscored group takes part in the mean limit with 0.
    assert m["threshold_value"] == pytest.approx(0.05) and m["precision_anomalous"] == 0.5
    assert m["recall_anomalous"] == pytest.approx(1 / 3) and m["f1_score_anomalous"] == pytest.approx(0.4)
    assert m["predicted_anomaly_rate"] == pytest.approx(200 / 7)
    assert got["DBSCAN", "f"]["threshold_value"] is None and got["DBSCAN", "f"]["separation_score"] == 0
    assert [got["M", "absent"][c] for c in evaluate.COUNTS] == [0, 0, 0, 0] and got["M", "absent"]["recall_normal"] == 0


def test_a_single_run_has_no_std(spark):
    df = table(spark)
    limits = thresholds.gmm_limits(df)
    out = evaluate.over_runs(evaluate.evaluate(df, limits, thresholds.predict(df, limits), ["f"])).collect()
    assert all(r["recall_normal_std"] is None and r["recall_normal_mean"] is not None for r in out)


def test_iqr_sweep_gives_one_prediction_per_multiplier(spark):
    df = spark.createDataFrame(rows_of("a", [1.0, 2.0, 3.0, 4.0, 5.0], [(0, 4.5), (1, 9.5)]), SCHEMA)
    limits = thresholds.iqr_limits(df)
    assert {r["multiplier"]: r["threshold_value"] for r in limits.collect()}[1.5] == 7.0 and limits.count() == 13
    cm = {r["multiplier"]: [r[c] for c in evaluate.COUNTS]
          for r in evaluate.confusion(thresholds.predict(df, limits)).collect()}
    assert cm[0.0] == [1, 1, 0, 0] and cm[1.5] == [1, 0, 0, 1] and cm[2.5] == [1, 0, 0, 1]


def result_rows(spark):
    names = [c for c in ["threshold_value_mean", "separation_score"]] + [f"{m}_mean" for m in evaluate.METRICS]
    rows = []
    for ds in ("bpi_2012.csv", "small_log"):
        for i, (lv, fs) in enumerate([("L3_Global", "pure_cyclical"), ("L2_Activity", "delta_t"), ("L1_Micro", "delta_t")]):
            rows.append((ds, "IsolationForest", lv, fs, *[0.1 * (i + 1)] * len(names)))
    return spark.createDataFrame(rows, "dataset string, model string, level string, feature_set string, "
                                 + ", ".join(f"{n} double" for n in names))


def test_comparison(spark):
    from logsieve.plans.experiment import generate_comparison

    picked = compare.average_metrics(compare.candidates(result_rows(spark)))
    best = compare.select_best(picked, "separation_score").collect()
    assert {(r["ds_clean"], r["level"]) for r in best} == {("bpi_2012", "L2_Activity"), ("small_log", "L2_Activity")}
    wide = generate_comparison(result_rows(spark)).collect()
    assert len(wide) == 36
    row = next(r for r in wide if (r["ds_clean"], r["class"], r["metric"]) == ("bpi_2012", "Average", "Recall"))
    assert row[compare.BASELINE] == "0.596" and row[compare.ORACLE] == "0.200"
    fixed = compare.config_text("5. Fixed Config Cyclical", compare.FIXED_CONFIGS["5. Fixed Config Cyclical"])
    assert row[fixed] == "0.100"
    assert next(r for r in wide if r["ds_clean"] == "large_log")[compare.ORACLE] is None
    labels = compare.selection_labels(compare.baseline_table(spark), compare.select_best(picked, "separation_score"),
                                      compare.select_best(picked, "f1_score_anomalous_mean")).collect()
    assert {r["label"] for r in labels if r["ds_clean"] == "bpi_2012"} == {
        "bpi_2012\n[GMM: L2 | delta_t]\n[Oracle: L2 | delta_t]"}
    assert {r["label"] for r in labels if r["ds_clean"] == "large_log"} == {"large_log"}


def test_chart_table(spark):
    got = compare.chart_ready(result_rows(spark), levels=["L3_Global", "L2_Activity"]).collect()
    assert len(got) == 2 * 2 * 7 and {r["level_ord"] for r in got} == {1, 2}


def test_sweep_by_ranks_equals_one_prediction_per_limit(spark):
    """Nulls, ties with limits, equal limits of a key, keys without limits, noise flags and groups without test rows."""
    import random

    rng = random.Random(8)
    ks = [-0.5, 0.0, 0.25, 1.5]
    rows, limits = [], []
    for g in range(12):
        model = "DBSCAN" if g % 4 == 3 else "ZScore"
        for i in range(40):
            score = rng.choice([None, 0.0, 1.0]) if model == "DBSCAN" else rng.choice([None, -1.0, 0.0, *range(1, 9)])
            rows.append((1, "L2_Activity", f"a{g}", "", f"{g}-{i}", rng.choice(["val"] if g == 10 else ["train", "val", "test"]),
                         rng.randrange(2), model, "delta_t", None if score is None else float(score)))
        if model != "DBSCAN" and g != 5:
            limits += [(1, "L2_Activity", f"a{g}", "", model, "delta_t", k, 3.0 if g == 6 else 2.0 + 4 * k, 0.0) for k in ks]
    scores = spark.createDataFrame(rows, "run int, level string, g_act string, g_res string, event_key string, split string, "
                                         "is_true_anomaly int, model string, feature_set string, score double")
    limits = spark.createDataFrame(limits, "run int, level string, g_act string, g_res string, model string, feature_set string, "
                                           "multiplier double, threshold_value double, separation_score double")
    got = evaluate.sweep_confusion(thresholds.exceeded(scores, limits, ks), limits, ks)
    every = spark.createDataFrame([(k,) for k in ks], "multiplier double")
    keys = thresholds.score_keys(scores)
    copied = scores.crossJoin(every).join(limits, [*keys, "multiplier"], "left")
    above = F.coalesce(F.when(F.col("model") == "DBSCAN", F.col("score") == 1.0)
                       .otherwise(F.col("score") > F.coalesce("threshold_value", F.lit(0.0))), F.lit(False))
    want = evaluate.group_confusion(copied.withColumn("predicted", above.cast("int"))).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 44


def test_scores_are_stored_once_per_event_and_run(spark, monkeypatch):
    from logsieve.operators import scale
    from logsieve.plans import queries

    from conftest import SF

    stored, write = [], scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda df: stored.append(write(df)) or stored[-1])
    scores = queries.z_scores(spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert max(df.count() for df in stored) == len(queries.RUNS) * events
    assert scores.count() == len(queries.RUNS) * events * 3 * len(queries.O.SCORERS)
    facts = scores.groupBy("run", "level", "model", "feature_set").count().collect()
    assert {r["count"] for r in facts} == {events} and len(facts) == len(queries.RUNS) * 3 * len(queries.O.SCORERS)
