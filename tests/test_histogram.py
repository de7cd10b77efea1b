import math
import random

import pytest

from logsieve.operators import histogram


@pytest.mark.parametrize("limit", [2_000_000, 10])
def test_bins_keep_their_relative_error(spark, limit):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(2_000)]
    values += [sign * 2.0 ** e for e in range(-60, 60, 7) for sign in (-1, 1)] + [0.0, 0.0, 1.0, math.nextafter(2.0, 0), 3.0]
    rows = [(i % 3, "k", v) for i, v in enumerate(values)] + [(0, "k", None), (0, "one", 7.25)]
    frame = spark.createDataFrame(rows, "part int, key string, v double")
    parts = histogram.histogram(frame, ["part", "key"], "v")
    whole = histogram.merge(parts, ["key"])
    direct = histogram.histogram(frame, ["key"], "v")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, direct.select(*whole.columns).collect()))
    bins = whole.where("key = 'k'").collect()
    assert sum(b.n for b in bins) == len(values)
    for b in bins:
        inside = [v for v in values if (abs(b.near) <= abs(v) < abs(b.far) and v * b.near > 0) or v == b.near]
        assert len(inside) == b.n and abs(b.far - b.near) <= abs(b.near) / 32
    points = {f"q{i}": i / 20 for i in range(21)}
    got = {r.key: r for r in histogram.quantiles(whole, ["key"], points, limit).collect()}
    exact = sorted(values)
    for name, q in points.items():
        want = exact[math.floor((len(values) - 1) * q)]
        assert abs(got["k"][name] - want) <= abs(want) / 64 + 1e-300
    assert got["one"].q0 == pytest.approx(7.25, rel=1 / 64)
