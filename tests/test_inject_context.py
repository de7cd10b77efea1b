import pytest
from pyspark.sql import functions as F

from logsieve.operators import context, features, inject, order, split


def log_of(make_log, n=200, activities="abcd", resource=True):
    return make_log([(f"c{i % 20}", activities[(i * 7) % len(activities)], f"r{i % 3}", i * 100.0 + i % 13)
                     for i in range(n)], resource)


def test_injection_counts_and_rules(make_log):
    log = order.order_events(log_of(make_log))
    out = inject.inject_anomalies(log, 0.1, [1, 2, 3])
    facts = out.groupBy("run").agg(F.sum("activity_label").alias("a"), F.sum("time_label").alias("t")).collect()
    assert {(r["run"], r["a"], r["t"]) for r in facts} == {(1, 20, 20), (2, 20, 20), (3, 20, 20)}
    both = out.alias("n").join(log.alias("o"), "event_key").select(
        "n.run", "n.activity_label", "n.time_label", "n.event_seq", (F.col("n.activity") != F.col("o.activity")).alias("swap"),
        (F.col("n.time_us") - F.col("o.time_us")).alias("moved"), F.col("o.event_seq").alias("seq")).collect()
    assert all(r["swap"] == (r["activity_label"] == 1) for r in both)
    assert all(r["moved"] >= 0 and (r["time_label"] == 1 or r["moved"] == 0) for r in both)
    assert all(r["event_seq"] > 1 for r in both if r["time_label"]) and all(r["event_seq"] == r["seq"] for r in both)
    assert any(r["moved"] > 0 for r in both)
    assert len({frozenset(r["event_key"] for r in out.where(f"run = {k} and time_label = 1").collect())
                for k in (1, 2, 3)}) == 3


def test_injection_does_not_depend_on_partitions(make_log):
    log = log_of(make_log)
    runs = []
    for n in (1, 7, 32):
        out = inject.inject_anomalies(order.order_events(log.repartition(n)), runs=[1])
        runs.append(sorted((r["event_key"], r["activity"], r["time_us"]) for r in out.collect()))
    assert runs[0] == runs[1] == runs[2]


def test_injection_refuses_impossible_logs(make_log):
    with pytest.raises(ValueError, match="single activity"):
        inject.inject_anomalies(order.order_events(log_of(make_log, 40, "a")), runs=[1])
    single = make_log([(f"c{i}", "ab"[i % 2], "r", i) for i in range(20)])
    with pytest.raises(ValueError, match="not first"):
        inject.inject_anomalies(order.order_events(single), runs=[1])


def one_key(make_log, split_at, gaps):
    """One case; its first events train, the rest test."""
    rows, t = [], 0.0
    for a, g in gaps:
        t += g
        rows.append(("c", a, "r", t))
    log = order.order_events(make_log(rows))
    return log.withColumn("split", F.when(F.col("event_seq") <= split_at, "train").otherwise("test"))


def test_key_seen_once_has_std_zero_and_unseen_key_mean_zero(make_log):
    log = one_key(make_log, 3, [("a", 0), ("b", 10), ("b", 30), ("c", 5), ("a", 7)])
    f = features.base_features(log)
    stats = context.fit_context_stats(f, ["activity", "transition"])
    got = {r["event_seq"]: r for r in context.apply_context_stats(f, stats, ["activity", "transition"]).collect()}
    assert got[4]["z_score_act"] == pytest.approx(5 / 1e-6)
    assert got[4]["expected_act_duration"] == 0
    # 'a' was seen once, with gap 0: mean 0, std 0.
    assert got[5]["z_score_act"] == pytest.approx(7 / 1e-6)
    assert got[3]["expected_act_duration"] == pytest.approx(20)
    assert got[3]["z_score_act"] == pytest.approx(10 / (200 ** 0.5 + 1e-6))
    assert got[1]["prev_act"] == "START"


def test_missing_resources_form_one_resource(make_log):
    rows = [("c", "a", None if i % 2 else "x", i * 10.0) for i in range(12)]
    log = split.split_by_rows(order.order_events(make_log(rows)))
    got = context.context_features(features.base_features(log)).select("resource").distinct().collect()
    assert {r[0] for r in got} == {"0", "x"}


def test_large_statistics_are_joined_by_shuffle(make_log, monkeypatch):
    log = split.split_by_rows(order.order_events(log_of(make_log)))
    f = features.base_features(log)
    stats = context.fit_context_stats(f)
    plain = context.apply_context_stats(f, stats).orderBy("event_key").toPandas()
    monkeypatch.setattr(context.scale, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(context.scale.lookup_join, "__defaults__", (None, "left", 0, 20))
    shuffled = context.apply_context_stats(f, stats).orderBy("event_key").toPandas()
    assert plain.equals(shuffled[plain.columns])


def test_moments_are_exact(spark):
    import statistics
    from fractions import Fraction

    values = {"a": [5], "b": [10 ** 11 + i for i in (0, 1, 3)], "c": [3, 3, 3], "d": [7 ** k for k in range(20)],
              "e": [9 * 10 ** 17 + i * 10 ** 15 for i in range(50)]}
    rows = [(k, v) for k, some in values.items() for v in some]
    mean, std = inject.exact_moments(F.col("v"))
    frame = spark.createDataFrame(rows, "k string, v long")
    both = [frame.repartition(p, "v").groupBy("k").agg(mean.alias("m"), std.alias("s")).collect() for p in (1, 7)]
    assert sorted(both[0]) == sorted(both[1])
    for r in both[0]:
        some = values[r.k]
        assert r.m == pytest.approx(float(Fraction(sum(some), len(some))), rel=1e-15)
        assert r.s == pytest.approx(float(statistics.stdev(map(Fraction, some))) if len(some) > 1 else 0.0, rel=1e-12)


def test_context_features_run_the_plan_of_their_input_once(spark, make_log):
    log = order.order_events(make_log([(f"c{i % 3}", "ab"[i % 2], f"r{i % 2}", 60 * i) for i in range(30)]))
    log = features.base_features(log.withColumn("split", F.lit("train")))
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for part in rows:
            seen.add(part.num_rows)
            yield part

    feats = log.select("*").mapInArrow(count, log.schema)
    feats = feats.select(*[F.col(c).alias(c, metadata=log.schema[c].metadata) for c in log.columns])
    assert context.context_features(feats).count() == 30
    assert seen.value == 30
