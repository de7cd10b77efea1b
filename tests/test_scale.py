import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import scale


def table(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 40, n).astype(str))
    rows = [(str(k), int(v), f"{i:05d}") for i, (k, v) in enumerate(zip(key, rng.integers(0, 50, n)))]
    return spark.createDataFrame(rows, "k string, v bigint, id string").repartition(7), rows


def test_running_split_over_segments_equals_one_window(spark):
    df, _ = table(spark)
    args = (df, ["k"], ["v", "id"], {"n": F.lit(1).cast("bigint"), "s": F.col("v")})
    whole = {"top": F.max("v"), "all": F.sum("v")}
    plain = scale.running(*args, whole=whole).toPandas().sort_values("id").reset_index(drop=True)
    cut = scale.running(*args, limit=100, whole=whole).toPandas().sort_values("id").reset_index(drop=True)
    assert plain.equals(cut[plain.columns])


def test_running_without_keys(spark):
    df, rows = table(spark, 500)
    got = scale.running(df, [], ["v", "id"], {"n": F.lit(1).cast("bigint")}, limit=50)
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_keys_at_finds_positions_with_many_equal_values(spark):
    df, rows = table(spark)
    keyed = df.select(F.col("k").alias("g"), "v", F.col("id").alias("tie"))
    by = {}
    for k, v, i in rows:
        by.setdefault(k, []).append((v, i))
    targets = {(k, p): (k, p) for k in ("hot", "1", "2") for p in (0, 5, 17, len(by[k]) - 1)}
    want = {t: sorted(by[t[0]])[t[1]] for t in targets}
    assert scale.keys_at(keyed, targets, 0, 49, take=3, digits=2) == want
    assert scale.keys_at(keyed, targets, 0, 49, rows=3000) == want


def test_keys_at_with_one_tie_breaker_for_all(spark):
    df = spark.createDataFrame([("", 5, "same")] * 30, "g string, v bigint, tie string")
    assert scale.keys_at(df, {"a": ("", 12)}, 0, 100, take=3) == {"a": (5, "same")}


def test_lookup_join_by_shuffle_with_heavy_and_null_keys(spark):
    df, _ = table(spark)
    df = df.withColumn("k", F.when(F.col("k") != "3", F.col("k")))
    names = df.where("k <> '4'").groupBy("k").agg(F.max("v").alias("m"))
    for how in ("left", "inner"):
        a = scale.lookup_join(df, names, ["k"], how=how).orderBy("id").toPandas()
        b = scale.lookup_join(df, names, ["k"], how=how, limit=3, hot_rows=100).orderBy("id").toPandas()
        assert a.equals(b[a.columns])
    assert len(a) < 3000


def test_chained_lookups_read_the_left_side_once(spark):
    df, _ = table(spark)
    left = scale.materialise(df)
    out = left
    for i in range(4):
        names = df.groupBy("k").agg(F.max("v").alias(f"m{i}"))
        out = scale.lookup_join(out, names, ["k"], limit=3, hot_rows=100, base=left)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 + 4
    assert out.count() == 3000


class Session:
    """As much of a session as is looked at."""

    def __init__(self, master, **conf):
        self.conf = self
        self.values = conf
        self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return self.values.get(key.replace(".", "_"), default)


def test_shared_dir_comes_from_the_session():
    assert scale.shared_dir(Session("yarn", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    assert scale.shared_dir(Session("local[2]")) == scale.shared_dir(Session("local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.shared_dir(Session("yarn"))


def test_lookup_with_counts_of_its_keys_does_not_count_them_again(spark, monkeypatch):
    left = spark.range(600).selectExpr("if(id < 400, 7, id) AS k", "id AS v")
    table = scale.materialise(spark.range(1_000).selectExpr("id AS k", "id * 2 AS w"))
    counts = scale.materialise(left.groupBy("k").count().withColumnRenamed("count", "_n"))
    monkeypatch.setattr(scale, "heavy_keys", lambda *a, **k: pytest.fail("counted again"))
    out = scale.lookup_join(left, table, ["k"], 1_000, limit=0, hot_rows=100, counts=counts)
    assert sorted((r.v, r.w) for r in out.collect()) == [(i, 14 if i < 400 else 2 * i) for i in range(600)]
