import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from logsieve.operators import compare, evaluate, levels, scale
from logsieve.plans import experiment as E
from logsieve.sources.sinks import write_scores
from logsieve.sources.readers import read_report, read_scores, unpivot_scores
from logsieve.sources.sinks import wide_scores, write_log_once, write_report
from logsieve.sources.spec import EventLogSpec, has_resource

SETS = {"delta_t": ["delta_t"], "pure_cyclical": ["hour_sin", "hour_cos", "day_sin", "day_cos"]}


def write_csv(folder, name, resource, n=240):
    rng = np.random.default_rng(len(name))
    lines = ["Case ID,Activity,Complete Timestamp" + (",Resource" if resource else "")]
    for i in range(n):
        t = np.datetime64("2024-01-01T00:00:00") + np.timedelta64(int(i * 1800 + rng.integers(0, 900)), "s")
        lines.append(f"c{i % 12},{'abc'[rng.integers(3)]},{str(t).replace('T', ' ')}" + (f",r{i % 2}" if resource else ""))
    (folder / name).write_text("\n".join(lines) + "\n")


def test_from_csv_to_comparison(spark, tmp_path):
    raw, work = tmp_path / "raw", tmp_path / "work"
    raw.mkdir()
    write_csv(raw, "bpi_2012.csv", True)
    write_csv(raw, "small_log.csv", False)
    options = dict(runs=[1, 2], feature_sets=SETS)
    assert E.generate_and_score(spark, str(raw), str(work), **options) == ["bpi_2012.csv", "small_log.csv"]
    scores = read_scores(spark, f"{work}/scores")
    have = {(r["dataset"], r["level"]) for r in scores.select("dataset", "level").distinct().collect()}
    assert have == {("bpi_2012", "L3_Global"), ("bpi_2012", "L2_Activity"), ("bpi_2012", "L1_Micro"),
                    ("small_log", "L3_Global"), ("small_log", "L2_Activity")}
    per = scores.groupBy("dataset", "run", "model", "level", "feature_set").count().collect()
    assert {r["count"] for r in per} == {240} and len(per) == 2 * 3 * 2 * 5
    assert read_scores(spark, f"{work}/scores", ["small_log"]).count() == 240 * 2 * 3 * 2 * 2

    table = E.evaluate_scores(scores, str(tmp_path / "metrics"), feature_sets=tuple(SETS))
    assert table.count() == 3 * 2 * 5
    again = read_report(spark, str(tmp_path / "metrics"))
    assert again.count() == table.count() and set(again.columns) == set(table.columns)
    wide = E.generate_comparison(again, path=str(tmp_path / "comparison")).collect()
    assert {r["ds_clean"] for r in wide} == {"bpi_2012", "bpi_2013", "small_log", "large_log"}
    sweep = E.metrics_table(scores, tuple(SETS), "iqr", [0.0, 1.5])
    assert sweep.count() == 2 * 3 * 2 * 5 * 2


def test_prepared_logs_are_reused(spark, tmp_path, make_log):
    log = make_log([(f"c{i % 5}", "ab"[i % 2], "r", i * 60.0) for i in range(50)])
    spec = EventLogSpec("case_id", "activity", "time", "resource", "event_key")
    calls = []

    def make(runs):
        calls.append(list(runs))
        return E.prepare(log, spec, runs)

    first = write_log_once(spark, str(tmp_path), "d", [1, 2], make)
    second = write_log_once(spark, str(tmp_path), "d", [1, 2, 3], make)
    assert calls == [[1, 2], [3]] and first.count() == 100 and second.count() == 150 and has_resource(second)


def test_scores_of_other_runs_stay(spark, tmp_path):
    def scores(run, value):
        return spark.createDataFrame([("d", run, "m", "l", value)],
                                     "dataset string, run int, model string, level string, score double")

    for run, value in ((1, 0.1), (2, 0.2), (2, 0.3)):
        write_scores(scores(run, value), str(tmp_path / "s"))
    assert {(r.run, r.score) for r in read_scores(spark, str(tmp_path / "s")).collect()} == {(1, 0.1), (2, 0.3)}


def test_wide_scores_and_back(spark):
    long = spark.createDataFrame([("1", "LOF", "L3_Global", "delta_t", 1.5), ("2", "LOF", "L3_Global", "delta_t", None),
                                  ("1", "DBSCAN", "L3_Global", "delta_t", 0.0), ("2", "DBSCAN", "L3_Global", "delta_t", 1.0)],
                                 "event_key string, model string, level string, feature_set string, score double")
    wide = wide_scores(long, ["event_key"], [("LOF", "L3_Global", "delta_t"), ("DBSCAN", "L3_Global", "delta_t")])
    assert {r["event_key"]: r["score_LOF_L3_Global_delta_t"] for r in wide.collect()} == {"1": 1.5, "2": 0.0}
    back = unpivot_scores(wide, ["event_key"]).select(*long.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, long.collect()))


def test_report_is_one_file(spark, tmp_path):
    write_report(spark.range(20).repartition(5), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1


def test_plan_of_the_features_shuffles_once(spark):
    from logsieve.plans.queries import feats

    plan = feats(spark, SF, poison=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan


def test_profiles_of_all_datasets_in_one_report(spark, tmp_path):
    head = "Case ID,Activity,Complete Timestamp,Resource"
    lines = [f"{i % 7},A{i % 2},2024-01-{1 + i // 24:02} {i % 24:02}:00:00,R{i % 3}" for i in range(200)]
    for name in ("bpi_2012.csv", "bpi_2013.csv"):
        (tmp_path / name).write_text("\n".join([head, *lines]) + "\n")
    table = E.analyze_datasets(spark, str(tmp_path), str(tmp_path / "out"))
    assert {(r.dataset, r.level) for r in table.collect()} == {
        (d, lv) for d in ("bpi_2012", "bpi_2013") for lv in ("L3_Global", "L2_Activity", "L1_Micro")}
    assert read_report(spark, str(tmp_path / "out")).count() == 6 and len(list((tmp_path / "out").glob("*.csv"))) == 1
    for r in table.collect():
        assert r.total_events == 200 and r.avg_delta_t_mean_hours == round(r.avg_delta_t_mean_hours, 2)
    assert E.analyze_datasets(spark, str(tmp_path / "none")) is None


def test_comparison_and_wide_reports(spark, tmp_path):
    stats = [f"{m}_{s}" for m in evaluate.METRICS for s in ("mean", "std")]
    rows = [(d, "IsolationForest", lv, fs, 0.5, float(i), *[0.1 * (i % 5)] * len(stats))
            for d in ("bpi_2012.csv", "bpi_2013.csv") for i, (lv, fs) in enumerate(
                (lv, fs) for lv in levels.LEVELS for fs in levels.FEATURE_SETS)]
    table = spark.createDataFrame(rows, "dataset string, model string, level string, feature_set string, threshold_value_mean "
                                        "double, separation_score double, " + ", ".join(f"{c} double" for c in stats))
    E.write_comparison(table, str(tmp_path))
    counts = {n: read_report(spark, str(tmp_path / n)).count() for n in ("wide", "long", "labels", "chart")}
    assert counts["wide"] == 9 * len(compare.BASELINE_SCORES) and counts["labels"] == len(compare.BASELINE_SCORES)
    assert counts["long"] == counts["wide"] + 9 * 2 * 4 and counts["chart"] == len(rows) * len(compare.CHART_METRICS)
    scores = spark.createDataFrame([("d", r, f"e{i}", "test", i % 2, "LOF", lv, "delta_t", float(i)) for r in (1, 2)
                                    for lv in ("L3_Global", "L2_Activity") for i in range(4)],
                                   "dataset string, run int, event_key string, split string, is_true_anomaly int, model string, "
                                   "level string, feature_set string, score double")
    E.write_wide_scores(scores, str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    assert wide.count() == 8 and {"score_LOF_L3_Global_delta_t", "score_LOF_L2_Activity_delta_t"} <= set(wide.columns)


def test_scores_are_written_with_open_files_and_without_sorting(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from logsieve.sources import sinks

    name, seen, parquet = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(name)), parquet(self, *a, **k)))
    rows = [("d", r, m, lv, f"e{i}", float(i)) for r in (1, 2) for m in "ab" for lv in "xy" for i in range(5)]
    df = spark.createDataFrame(rows, "dataset string, run int, model string, level string, event_key string, score double")
    before = spark.conf.get(name)
    # Fewer files than partitions: the rest of a task's rows is sorted.
    for files in (32, 3):
        monkeypatch.setattr(sinks, "OPEN_FILES", files)
        path = str(tmp_path / str(files))
        sinks.write_scores(df.coalesce(1), path)
        assert sorted(spark.read.parquet(path).select(*df.columns).collect()) == sorted(rows)
    assert seen == ["32", "3"] and spark.conf.get(name) == before
