import numpy as np
import pytest

from __spark_entry__ import queries
from conftest import SF
from logsieve.operators import levels
from logsieve.plans.queries import vectors
from test_detectors import brute_dbscan, brute_lof

KEY = ["level", "g_act", "g_res", "feature_set"]


@pytest.fixture(scope="module")
def data(spark):
    """Events of every level on every feature set."""
    v = vectors(spark, SF, list(levels.FEATURE_SETS), levels.LEVELS)
    rows = v.select("event_key", *KEY, "split", "x").toPandas().sort_values("event_key")
    return {k: (g["event_key"].tolist(), np.array(g["x"].tolist(), np.float32), g["split"].to_numpy())
            for k, g in rows.groupby(KEY)}


def test_density_queries_cover_all_levels_and_sets(spark, data):
    assert {(k[0], k[3]) for k in data} == {(x, s) for x in levels.LEVELS for s in levels.FEATURE_SETS}
    want = {k: brute_dbscan(x) for k, (_, x, _) in data.items() if len(x) > 5}
    assert {k[0] for k in want} == set(levels.LEVELS)
    eps = {tuple(r[c] for c in KEY): r["eps"] for r in queries()["kdist_knee_eps_all_levels"](spark, SF).collect()}
    assert set(eps) == set(data)
    for name, at in (("knn_distance_all_levels", 0), ("dbscan_noise_all_levels", 2)):
        got = queries()[name](spark, SF).toPandas().sort_values("event_key")
        got = {k: (g["event_key"].tolist(), g["score"].to_numpy()) for k, g in got.groupby(KEY)}
        assert set(got) == set(data)
        for k, (events, *_) in data.items():
            assert got[k][0] == events
            if k in want:
                assert np.allclose(got[k][1], want[k][at].astype(float), rtol=1e-9, atol=1e-12), (name, k)
                assert eps[k] == pytest.approx(want[k][1], rel=1e-9)


def test_lof_covers_all_levels_and_sets(spark, data):
    got = queries()["lof_scores_all_levels"](spark, SF).toPandas().sort_values("event_key")
    got = {k: g["score"].to_numpy() for k, g in got.groupby(KEY)}
    assert set(got) == set(data)
    for k, (_, x, split) in data.items():
        # Among points at equal distance at the end of a list any may be taken.
        want = brute_lof(x, split)
        assert np.mean(np.isclose(got[k], want, rtol=1e-6)) > 0.98, k
