import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsieve.operators import density, forest, knn, levels, line, scale

N = 400


def vectors(spark, sets, seed=1):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for name, d in sets.items():
        x = rng.exponential(size=(N, d)).astype(np.float32)
        x[:100] = np.round(x[:100], 1)
        x[100:160] = x[0]
        split = np.where(rng.random(N) < 0.6, "train", "test")
        data[name] = x, split
        rows += [("L3_Global", "", "", name, f"{i:05d}", str(split[i]), [float(v) for v in x[i]]) for i in range(N)]
    df = spark.createDataFrame(rows, "level string, g_act string, g_res string, feature_set string, event_key string, "
                                     "split string, x array<float>")
    return df, data


def distances(x):
    d = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        d += (x[:, None, j].astype(float) - x[None, :, j]) ** 2
    return np.sqrt(d)


def brute_dbscan(x, k=5):
    d = distances(x)
    kd = np.sort(d, axis=1)[:, k - 1]
    s = np.sort(kd)
    i, n = np.arange(len(s)), len(s)
    eps = max(0.01, s[np.argmax(np.abs(i * (s[-1] - s[0]) - (s - s[0]) * (n - 1)))])
    core = (d <= eps).sum(axis=1) >= k
    return kd, eps, ~(core | ((d <= eps) & core[None, :]).any(axis=1))


def brute_lof(x, split, k=20):
    d = distances(x)
    train = np.flatnonzero(split == "train")
    first = {}
    rep = np.array([first.setdefault(tuple(r), i) for i, r in enumerate(x)])
    k = min(k, len(train) - 1)

    def near(i, others):
        pick = others[np.lexsort((others, rep[others], d[i, others]))[:k]]
        return pick, d[i, pick]

    fit = {i: near(i, train[train != i]) for i in train}
    kd = {i: v[1][-1] for i, v in fit.items()}

    def density_of(pick, dist):
        return 1 / (np.mean(np.maximum(dist, [kd[j] for j in pick])) + 1e-10)

    lrd = {i: density_of(*v) for i, v in fit.items()}
    asked = [near(i, train) for i in range(len(x))]
    return np.array([np.mean([lrd[j] for j in a[0]]) / density_of(*a) for a in asked])


def scores(df, name):
    return np.array([r["score"] for r in df.where(F.col("feature_set") == name).orderBy("event_key").collect()])


@pytest.mark.parametrize("leaf", [4096, 40])
def test_density_detectors_equal_brute_force(spark, leaf):
    df, data = vectors(spark, {"one": 1, "three": 3})
    kd, noise, lof = (f(df, leaf=leaf) for f in (density.neighbour_distance, density.dbscan_noise, density.lof))
    for name, (x, split) in data.items():
        want = brute_dbscan(x)
        assert np.array_equal(scores(kd, name), want[0])
        assert np.array_equal(scores(noise, name), want[2].astype(float))
        assert np.allclose(scores(lof, name), brute_lof(x, split), rtol=1e-9)


@pytest.mark.parametrize("dims, k", [(2, 5), (5, 21)])
def test_search_compares_few_pairs_and_finds_the_same(monkeypatch, dims, k):
    rng = np.random.default_rng(dims)
    x = rng.random((4_000, dims)).round(2 if dims == 2 else 5)
    weight, ks, r = rng.integers(1, 3, len(x)), np.full(len(x), k), np.where(rng.random(len(x)) < 0.2, 0.01, np.inf)
    want = knn.nearest(x, x.T, weight, ks, r)
    pairs, plain = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda q, p, *a: (pairs.append(len(q) * p.shape[1]), plain(q, p, *a))[1])
    got = knn.search(x, x, weight, ks, r)
    order = np.lexsort((got[1], got[2], got[0]))
    assert all(np.array_equal(a[order], b) for a, b in zip(got, want))
    assert sum(pairs) < len(x) ** 2 / 3


def test_search_with_values_that_are_no_numbers():
    x = np.random.default_rng(1).random((500, 2))
    x[::7, 1] = np.nan
    args = np.ones(500, dtype=int), np.full(500, 3), np.full(500, np.inf)
    assert all(np.array_equal(a, b) for a, b in zip(knn.search(x, x, *args), knn.nearest(x, x.T, *args)))


def test_queries_reach_the_boxes_within_their_radius():
    asking = pd.DataFrame({"qid": ["a", "b", "c"], "x": [np.array([0.0, 0.0])] * 3, "k": 2, "r": [1.0, 2.0, np.inf], "cell": "h"})
    boxes = pd.DataFrame({"to": ["near", "far"], "lo_to": [np.array([1.0, 0.0, np.nan]), np.array([3.0, 0.0, np.nan])],
                          "hi_to": [np.array([2.0, 9.0, np.nan]), np.array([4.0, np.nan, np.nan])]})
    got = knn._reaching(list(asking.columns))(asking, boxes)
    assert sorted(zip(got.qid, got.cell)) == [("a", "near"), ("b", "near"), ("c", "far"), ("c", "near")]


def test_busy_cells_are_answered_in_parts(spark, monkeypatch):
    df, data = vectors(spark, {"two": 2})
    monkeypatch.setattr(knn, "VISITS", 30)
    assert np.array_equal(scores(density.neighbour_distance(df, leaf=60), "two"), brute_dbscan(data["two"][0])[0])


def test_lof_joins_long_lists_without_looking_for_heavy_neighbours(spark, monkeypatch):
    from logsieve.operators import scale

    rng = np.random.default_rng(5)
    rows = [("L2_Activity", "a", "", f"e{i:03d}", "train" if i % 3 else "val", "f", [float(v) for v in rng.normal(size=2)])
            for i in range(120)]
    v = spark.createDataFrame(rows, "level string, g_act string, g_res string, event_key string, split string, feature_set string, "
                                    "x array<float>")
    scores = lambda: {r["event_key"]: r["score"] for r in density.lof(v, k=6).collect()}
    want, looked, lookup = scores(), [], scale.lookup_join
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    # A lookup join looks for heavy keys.
    monkeypatch.setattr(scale, "lookup_join", lambda left, table, on, *a, **k: looked.append(on) or lookup(left, table, on, *a, **k))
    got = scores()
    assert len(got) == 120 and got == pytest.approx(want)
    assert looked and not any("pid" in on for on in looked)


def test_lof_with_other_fitting_vectors(spark):
    df, data = vectors(spark, {"two": 2})
    moved = df.withColumn("x", F.transform("x", lambda v: (v + F.lit(0.5)).cast("float")))
    a = density.lof(moved, fit_vectors=moved).orderBy("event_key").toPandas()
    b = density.lof(moved).orderBy("event_key").toPandas()
    assert np.allclose(a.score, b.score)


def curve(spark, values):
    return spark.createDataFrame([("g", float(v), 1) for v in values], "k string, d double, w bigint")


@pytest.mark.parametrize("values, eps", [([0.3] * 10, 0.3), ([0.001] * 10, 0.01), ([0.1, 0.2], 0.5),
                                         ([0.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.2, 5.0], 0.2)])
def test_knee(spark, values, eps):
    assert density.knee_eps(curve(spark, values), ["k"]).first()["eps"] == pytest.approx(eps)


def test_knee_of_long_curves_is_indexed_in_segments(spark):
    values = np.sort(np.random.default_rng(5).exponential(size=500)).round(2)
    a, b = (density.knee_eps(curve(spark, values), ["k"], limit=n).first() for n in (2_000_000, 50))
    assert a == b


def walk(x, feature, value):
    node = 0
    while feature[node] >= 0:
        node = 2 * node + 1 + (x[feature[node]] > value[node])
    return value[node]


def test_forest_scores_equal_walking_each_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    x[0] = 8
    draws = np.random.default_rng(3).random((40, 300)).argpartition(63, axis=1)[:, :64]
    feature, value = forest.grow(x, draws, forest.tree_depth(64), np.random.default_rng(1))
    mean = np.array([[walk(p, f, v) for f, v in zip(feature, value)] for p in x]).mean(axis=1)
    got = forest.depth_score(x, feature, value, 64, rows_at_once=70, cells=500)
    assert np.allclose(got, 2 ** (-mean / forest.path_length(64)), rtol=1e-6)
    assert got.argmax() == 0 and got[0] > 0.7


def test_forest_of_equal_points_and_path_length():
    feature, value = forest.grow(np.ones((50, 2), np.float32), np.tile(np.arange(50), (10, 1)), forest.tree_depth(50),
                                 np.random.default_rng(1))
    assert np.allclose(forest.depth_score(np.ones((3, 2), np.float32), feature, value, 50), 0.5)
    assert forest.path_length([1, 2]).tolist() == [0.0, 1.0]
    assert forest.path_length(256) == pytest.approx(10.244770920)


@pytest.mark.parametrize("n", [20, 300, 3_000, 200_000])
def test_each_tree_draws_its_own_sample_of_all_events(n):
    rng = np.random.default_rng(n)
    u, h = rng.random(n), rng.integers(-2 ** 63, 2 ** 63 - 1, n)
    trees, sample = 50, 64
    expected = forest.expected_candidates(sample)
    some = -np.expm1(np.log1p(-expected / n) * trees) if expected < n / 2 else 1.0
    rows = np.flatnonzero(u < some)
    got = forest.tree_samples(u[rows], h[rows], n, trees, sample, expected)
    assert got.shape == (trees, min(sample, n)) and all(len(set(t)) == len(t) for t in got.tolist())
    assert np.array_equal(got, forest.tree_samples(u[rows], h[rows], n, trees, sample, expected))
    got = rows[got]
    # Samples spread evenly over all events, and two trees share as many events as independent ones would.
    assert abs(got.mean() / (n - 1) - 0.5) < 5 / np.sqrt(12 * got.size)
    size, pairs = got.shape[1], trees * (trees - 1) / 2
    counts = np.bincount(got.ravel(), minlength=n)
    shared = (counts * (counts - 1) / 2).sum()
    want = pairs * size * size / n
    assert abs(shared - want) <= 6 * np.sqrt(want) and rows.size <= 1.3 * trees * expected
    # Too few candidates are noticed.
    if n > 1_000:
        assert forest.tree_samples(u[rows[:100]], h[rows[:100]], n, trees, sample, expected) is None


def scaled(spark, n=500):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 2 else "b", f"{i:04d}", "train" if i < 300 else "test", float(rng.exponential()) + 20 * (i >= 480),
             float(rng.normal()), None) for i in range(n)]
    df = spark.createDataFrame(rows, "activity string, event_key string, split string, p double, q double, resource string")
    sets = {"pq": ["p", "q"], "p": ["p"]}
    grouped = levels.with_levels(df, ["L3_Global", "L2_Activity"])
    ranges = levels.usable_groups(levels.group_ranges(grouped, sets))
    return levels.scaled_features(grouped, ranges, sets), sets


def test_forest_finds_anomalies_whatever_the_blocks_and_partitions(spark):
    df, sets = scaled(spark)
    got = []
    for n, block in ((1, 100_000), (9, 60)):
        model = forest.iforest_fit(df.repartition(n), sets, trees=50)
        out = forest.iforest_score(df.repartition(n), model, sets, block_rows=block)
        got.append(out.orderBy("level", "g_act", "feature_set", "event_key").toPandas())
    assert np.array_equal(got[0].score, got[1].score) and len(got[0]) == 500 * 2 * 2
    for _, part in got[0].groupby(["level", "feature_set"]):
        bad = part.event_key >= "0480"
        assert (part.score[bad].to_numpy()[:, None] > part.score[~bad].to_numpy()[None, :]).mean() > 0.95


def test_small_groups_are_left_out_but_not_the_global_one(spark):
    rows = [("a", f"{i}", "train" if i < 20 else "test", float(i), None) for i in range(40)]
    df = spark.createDataFrame(rows, "activity string, event_key string, split string, p double, resource string")
    ranges = levels.group_ranges(levels.with_levels(df, ["L3_Global", "L2_Activity"]), {"p": ["p"]})
    assert [r["level"] for r in levels.usable_groups(ranges).collect()] == ["L3_Global"]
    row = ranges.where("level = 'L3_Global'").first()
    assert (row["n"], row["n_train"], row["lo_p"], row["ptp_p"]) == (40, 20, 0.0, 19.0)


def test_jitter_is_small_and_differs_by_draw(spark):
    df, sets = scaled(spark, 60)
    rows = levels.with_levels(df.select("event_key", "split", "p", "q", F.lit("a").alias("activity"),
                                        F.lit(None).cast("string").alias("resource")).distinct(), ["L3_Global"])
    ranges = levels.group_ranges(rows, sets)
    base, a, b = (levels.scaled_features(rows, ranges, sets, j).orderBy("event_key", "p").toPandas()
                  for j in (None, "fit", "score"))
    assert 0 < abs(a.p - base.p).max() < 1e-5 and not np.array_equal(a.p, b.p)


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_neighbours_on_a_line(spark, limit):
    """Sorted neighbours against all distances, whole and in segments: repeated values, tiny groups, one value only."""
    rng = np.random.default_rng(3)
    groups = {"a": np.round(rng.normal(size=300), 2), "b": rng.random(3), "c": np.zeros(9), "d": np.arange(60.0), "e": np.ones(1),
              "f": np.concatenate([np.zeros(100), [5.0, 5.5, 9.0]])}
    rows = [("L2_Activity", g, "", "delta_t", f"{g}{i:03}", "train", [float(v)]) for g, some in groups.items()
            for i, v in enumerate(some)]
    vectors = spark.createDataFrame(rows, "level string, g_act string, g_res string, feature_set string, event_key string, "
                                          "split string, x array<float>")
    got = {r.event_key: r.score for r in density.neighbour_distance(vectors, limit=limit).collect()}
    noise = {r.event_key: r.score for r in density.dbscan_noise(vectors, limit=limit).collect()}
    eps = {r.g_act: r.eps for r in density.knee_eps(density.neighbour_distance(vectors).selectExpr(
        "level", "g_act", "g_res", "feature_set", "coalesce(score, 0D) AS d", "1L AS w"), density.vector_keys(vectors)).collect()}
    for g, some in groups.items():
        x = some.astype(np.float32).astype(float)
        d = np.abs(x[:, None] - x[None, :])
        kth = np.sort(d, axis=1)[:, 4] if len(x) >= 5 else np.full(len(x), np.nan)
        core = kth <= eps[g]
        lone = ~core & ~((d <= eps[g]) & core[None, :]).any(axis=1)
        for i in range(len(x)):
            key = f"{g}{i:03}"
            assert got[key] == (None if np.isnan(kth[i]) else kth[i]) and noise[key] == float(lone[i]), key
    stored = density.knn.collapse(vectors, density.vector_keys(vectors))
    sides = line.beside(stored, density.vector_keys(vectors), 5, ["w"], limit).where("g_act = 'd'").collect()
    for r in sides:
        assert [o.v for o in r.left] == [v for v in range(int(r.v) - 5, int(r.v)) if v >= 0]
        assert [o.v for o in r.right] == [v for v in range(int(r.v) + 1, int(r.v) + 6) if v < 60]


def test_cells_return_one_list_per_query_and_split_trees_cover_the_space(spark):
    """The lists of a cut group come whole from one shuffle; every point has a child cell, those without a number have none."""
    rng = np.random.default_rng(3)
    x = rng.random((700, 2)).astype(np.float32)
    x[5, 1] = np.nan
    points = spark.createDataFrame([("g", f"{i:04d}", v.tolist(), 1) for i, v in enumerate(x)],
                                   "g string, pid string, x array<float>, w bigint")
    points = scale.materialise(points)
    cells, _ = density.knn._cut(points.withColumn("cell", F.lit("")), ["g"], 100)
    cells = {r.pid: r.cell for r in cells.collect()}
    assert cells["0005"] == "" and all(c.endswith(".") for p, c in cells.items() if p != "0005")
    assert max(np.unique(list(cells.values()), return_counts=True)[1]) <= 100
    plain = scale.materialise(points.where("pid <> '0005'"))
    asking = plain.withColumnRenamed("pid", "qid").withColumn("k", F.lit(3))
    got = {r.qid: [(e.pid, e.d, e.before) for e in r.found] for r in density.knn.lists(plain, asking, ["g"], 100).collect()}
    assert len(got) == 699
    for i in range(0, 700, 50):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        near = np.argsort(np.where(np.isnan(d), np.inf, d), kind="stable")[:3]
        assert [e[0] for e in got[f"{i:04d}"]] == [f"{j:04d}" for j in near]
        assert np.allclose([e[1] for e in got[f"{i:04d}"]], d[near]) and [e[2] for e in got[f"{i:04d}"]] == [0, 1, 2]


def test_points_on_a_line_are_cut_into_segments_below_the_window_limit(spark, monkeypatch):
    df, data = vectors(spark, {"one": 1})
    monkeypatch.setattr(line, "STRETCH", 30)
    parts, split = [], scale.part_heavy
    monkeypatch.setattr(scale, "part_heavy", lambda *a: (parts.append(out := split(*a)), out)[1])
    got = scores(density.neighbour_distance(df), "one")
    assert np.array_equal(got, brute_dbscan(data["one"][0])[0])
    assert any(hot is not None for _, hot in parts)


def test_equal_events_walk_the_trees_once(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.tile(rng.random((40, 3)).astype(np.float32), (25, 1))
    line_x = rng.random((3_000, 1)).astype(np.float32)
    sets = {"wide": ["a", "b", "c"]}
    feature, value = forest.grow(x, np.tile(np.arange(64), (5, 1)), 6, rng)
    models = pd.DataFrame([["wide", 64, feature.shape[1], feature.tobytes(), value.tobytes()]],
                          columns=["feature_set", "psi", "nodes", "feature", "value"])
    want, seen, plain = forest.depth_score(x, feature, value, 64), [], forest.depth_score
    monkeypatch.setattr(forest, "depth_score", lambda p, *a: (seen.append(len(p)), plain(p, *a))[1])
    got = forest._score_block([], ["a", "b", "c"], sets, ["s"])(pd.DataFrame(x, columns=["a", "b", "c"]), models)
    assert np.array_equal(got["s"], want) and seen == [40]
    feature, value = forest.grow(line_x, np.array([rng.choice(3_000, 64, False) for _ in range(5)]), 6, rng)
    one = np.concatenate([plain(line_x[i:i + 1], feature, value, 64) for i in range(0, 3_000, 100)])
    seen.clear()
    assert np.array_equal(forest.depth_score(line_x, feature, value, 64)[::100], one) and seen[-1] < 400


def test_screened_pairs_are_those_within_the_radius_also_beside_values_far_away():
    rng = np.random.default_rng(6)
    x = rng.random((600, 6)).astype(np.float32).astype(float)
    x[::50, 2] = rng.choice([1e12, -3e7, 4e3], 12)
    x[7] = x[8]
    r = np.where(rng.random(600) < 0.5, 0.4, 0.0)
    r[::50] = 1e9
    d = np.zeros((600, 600))
    for j in range(6):
        d += (x[:, None, j] - x[None, :, j]) ** 2
    d, some = np.sqrt(d), np.arange(3, 600, 2)
    row, col, got = knn.Screen(x, x).within(np.arange(600), some, r, 400)
    want = np.nonzero(d[:, some] <= r[:, None])
    assert np.array_equal(row, want[0]) and np.array_equal(col, want[1]) and np.array_equal(got, d[row, some[col]])
    # Beyond what is asked for, the k nearest suffice.
    r[:] = 5.0
    row, col, got = knn.Screen(x, x).within(np.arange(600), some, r, 5)
    assert len(row) < 20 * 600
    kept = knn._completing(row, some[col], got, np.ones(600, int), np.full(600, 5))
    want = [np.lexsort((some, d[i, some]))[:5] for i in range(600)]
    assert np.array_equal(kept[1], np.concatenate([some[w[d[i, some[w]] <= 5.0]] for i, w in enumerate(want)]))


def test_distances_and_noise_store_no_lists_of_ids_and_do_not_count_vectors_again(spark, monkeypatch):
    df, data = vectors(spark, {"three": 3})
    stored, looked, store, heavy = [], [], scale.materialise, scale.heavy_keys
    monkeypatch.setattr(scale, "materialise", lambda d, **o: stored.append(d.dtypes) or store(d, **o))
    monkeypatch.setattr(scale, "heavy_keys", lambda d, keys, *a, **k: looked.append(keys) or heavy(d, keys, *a, **k))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    want = brute_dbscan(data["three"][0])
    for leaf in (4096, 60):
        assert np.array_equal(scores(density.neighbour_distance(df, leaf=leaf), "three"), want[0])
        assert np.array_equal(scores(density.dbscan_noise(df, leaf=leaf), "three"), want[2].astype(float))
    assert not [c for table in stored for c in table if c[1].startswith("array<") and "string" in c[1]]
    assert not any("x" in keys for keys in looked)


def test_noise_of_repeated_ids_is_complete_whole_and_in_cells(spark):
    df, _ = vectors(spark, {"two": 2})
    df = df.withColumn("event_key", F.when(F.col("event_key") < "00300", F.col("event_key")).otherwise(
        F.lpad((F.col("event_key").cast("int") % 60).cast("string"), 5, "0")))
    a, b = (density.dbscan_noise(df, leaf=leaf).orderBy("event_key", "score").toPandas() for leaf in (4096, 60))
    assert all(len(f) == N and f.score.isin([0.0, 1.0]).all() for f in (a, b)) and np.array_equal(a.event_key, b.event_key)


def test_knee_computes_the_distances_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = curve(spark, [0.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.2, 5.0])
    df = df.mapInPandas(counted, df.schema)
    assert density.knee_eps(df, ["k"]).first()["eps"] == 0.2 and seen.value == 8


def test_lof_writes_no_row_per_neighbour(spark, monkeypatch):
    df, data = vectors(spark, {"two": 2, "three": 3})
    stored, store = [], scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda d, **o: stored.append(store(d, **o)) or stored[-1])
    monkeypatch.setattr(scale, "discard", lambda *tables: None)
    monkeypatch.setattr(knn, "VISITS", 90)
    for leaf in (4096, 200):
        lof = density.lof(df, leaf=leaf)
        for name, (x, split) in data.items():
            assert np.allclose(scores(lof, name), brute_lof(x, split), rtol=1e-9)
    # Lists of 21 neighbours would be over 13,000 rows.
    assert max(table.count() for table in stored) < 5 * 2 * N


def test_lof_of_repeated_ids_and_of_a_single_training_event(spark):
    rng = np.random.default_rng(8)
    rows = [("L2_Activity", "a", "", f"e{i % 50:02d}", "train", "f", [float(v) for v in rng.normal(size=2)]) for i in range(60)]
    rows += [("L2_Activity", "b", "", f"e{i}", "train" if i == 0 else "test", "f", [float(i), 0.0]) for i in range(4)]
    rows += [("L2_Activity", "c", "", f"e{i}", "test", "f", [float(i), 0.0]) for i in range(4)]
    schema = "level string, g_act string, g_res string, event_key string, split string, feature_set string, x array<float>"
    got = {g: spark.createDataFrame([r for r in rows if r[1] in g], schema) for g in ("bc", "abc")}
    got = {g: density.lof(df, k=6).toPandas() for g, df in got.items()}
    assert len(got["bc"]) == 8 and got["bc"].score.isna().all()
    assert len(got["abc"]) == 68 and got["abc"].score.notna().sum() == 60
