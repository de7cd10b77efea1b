"""Score limits per group: two-component Gaussian mixtures and interquartile ranges."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scale
from .levels import group_keys

# Multipliers of the interquartile range.
IQR_MULTIPLIERS = [-0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5]
# Mixture fitting defaults.
MAX_ITERATIONS, TOLERANCE, VARIANCE_FLOOR = 100, 1e-3, 1e-6
GRID_POINTS = 1_000
FEW_SCORES = 5
# Distinct scores of a key up to which one task fits its mixture; above, the same steps run as aggregations.
TASK_POINTS = 65_536
_PARAMS = ["w0", "mu0", "var0", "w1", "mu1", "var1"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score_keys(scores: DataFrame) -> list[str]:
    return [*group_keys(scores), "model", "feature_set"]


def validation_scores(scores: DataFrame) -> DataFrame:
    return scores.where((F.col("split") == "val") & F.col("score").isNotNull())


def score_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores per key with their number n."""
    return scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))


def two_means(x, n):
    """Best split of sorted weighted points into two clusters: the first index of the upper one."""
    count, total = np.cumsum(n), np.cumsum(n * x)
    left, right = count[:-1], count[-1] - count[:-1]
    gain = total[:-1] ** 2 / left + (total[-1] - total[:-1]) ** 2 / right
    return int(np.argmax(gain)) + 1


def fit_mixture(x, n):
    """EM for two 1-D Gaussians on distinct sorted values x that occur n times; None when there is only one.

    Starts from the best two-cluster split. Returns weights, means and variances.
    """
    if len(x) < 2:
        return None
    upper = (np.arange(len(x)) >= two_means(x, n)).astype(float)
    resp = np.stack([1.0 - upper, upper])
    last = -np.inf
    for _ in range(MAX_ITERATIONS + 1):
        mass = (resp * n).sum(axis=1) + 10 * np.finfo(float).eps
        mean = (resp * n * x).sum(axis=1) / mass
        # Centred on the component mean, so that narrow components keep their precision.
        spread = (x - mean[:, None]) ** 2
        var = (resp * n * spread).sum(axis=1) / mass + VARIANCE_FLOOR
        weight = mass / mass.sum()
        log = np.log(weight)[:, None] - 0.5 * (np.log(2 * np.pi * var)[:, None] + spread / var[:, None])
        top = log.max(axis=0)
        norm = top + np.log(np.exp(log - top).sum(axis=0))
        resp = np.exp(log - norm)
        bound = (n * norm).sum() / n.sum()
        if abs(bound - last) < TOLERANCE:
            break
        last = bound
    return weight, mean, var


def _fit_key(keys):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        x, n = pdf["score"].to_numpy(np.float64), pdf["n"].to_numpy(np.float64)
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(n=int(n.sum()), mean=(n * x).sum() / n.sum(), mid=np.nan, **dict.fromkeys(_PARAMS, np.nan))
        if n.sum() <= FEW_SCORES:
            row["mid"] = float(np.median(np.repeat(x, n.astype(int))))
        else:
            made = fit_mixture(x, n)
            if made is None:
                row["mid"] = float(x[0])
            else:
                w, mu, var = made
                for i, at in enumerate(np.argsort(mu, kind="stable")):
                    row.update({f"w{i}": w[at], f"mu{i}": mu[at], f"var{i}": var[at]})
        return pd.DataFrame([row])[[*keys, "n", "mean", "mid", *_PARAMS]]

    return fit


def _step(points: DataFrame, params: DataFrame, keys: list[str], count: int, split: bool = False) -> DataFrame:
    """One pass over the points: the bound of the present parameters and, as ``new_*``, those of the next step.

    ``split`` takes the sides of the starting cut in place of the components. Sums are centred on the present means.
    """
    rows = scale.lookup_join(points, params, keys, count, "inner")
    x, n = F.col("score"), F.col("n")
    if split:
        resp = [F.when(x > F.col("cut"), F.lit(float(i))).otherwise(F.lit(1.0 - i)) for i in (0, 1)]
        norm = F.lit(0.0)
    else:
        log = [F.log(f"w{i}") - 0.5 * (F.log(2 * np.pi * F.col(f"var{i}")) + (x - F.col(f"mu{i}")) ** 2 / F.col(f"var{i}"))
               for i in (0, 1)]
        rows = rows.withColumns({"_l0": log[0], "_l1": log[1]})
        top = F.greatest("_l0", "_l1")
        norm = top + F.log(F.exp(F.col("_l0") - top) + F.exp(F.col("_l1") - top))
        resp = [F.exp(F.col(f"_l{i}") - norm) for i in (0, 1)]
    sums = []
    for i, r in enumerate(resp):
        away = x - F.col(f"mu{i}")
        sums += [(F.sum(n * r) + 10 * float(np.finfo(float).eps)).alias(f"_m{i}"), F.sum(n * r * away).alias(f"_s{i}"),
                 F.sum(n * r * away * away).alias(f"_q{i}")]
    kept = ["cut", "last", *_PARAMS]
    out = rows.groupBy(*keys).agg((F.sum(n * norm) / F.sum(n)).alias("bound"), *sums,
                                  *[F.first(c).alias(c) for c in kept])
    new = []
    for i in (0, 1):
        shift = F.col(f"_s{i}") / F.col(f"_m{i}")
        new += [(F.col(f"_m{i}") / (F.col("_m0") + F.col("_m1"))).alias(f"new_w{i}"),
                (F.col(f"mu{i}") + shift).alias(f"new_mu{i}"),
                (F.greatest(F.col(f"_q{i}") / F.col(f"_m{i}") - shift * shift, F.lit(0.0)) + VARIANCE_FLOOR)
                .alias(f"new_var{i}")]
    return out.select(*keys, *kept, "bound", *new)


def _fit_large(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mixtures of keys with many distinct scores: the steps of ``fit_mixture`` as aggregations over stored points.

    Each step joins the points of the keys still open with their parameters and keeps a few sums per key; the parameter
    table is stored in the shared folder and only the number of open keys reaches the driver.
    """
    total = F.col("n") * F.col("score")
    ranked = scale.running(points, keys, ["score"], {"c": F.col("n"), "t": total},
                           whole={"_c": F.sum("n"), "_t": F.sum(total)})
    rest = F.col("_c") - F.col("c")
    gain = F.col("t") * F.col("t") / F.col("c") + (F.col("_t") - F.col("t")) ** 2 / rest
    state = scale.materialise(ranked.where(rest > 0).groupBy(*keys).agg(
        F.max_by("score", F.struct(gain, -F.col("score"))).alias("cut"), F.first(F.col("_t") / F.col("_c")).alias("mean"),
        F.first("_c").alias("n")))
    facts, count = state, state.count()
    start = {p: F.col("mean") if p.startswith("mu") else F.lit(0.0) for p in _PARAMS}
    state = state.select(*keys, "cut", F.lit(None).cast("double").alias("last"), *[c.alias(p) for p, c in start.items()])
    renew = [F.col(f"new_{p}").alias(p) for p in _PARAMS]
    # Twice: the second pass is centred on the means of the first.
    for _ in range(2):
        state = scale.materialise(_step(points, state, keys, count, split=True).select(*keys, "cut", "last", *renew))
    state = state.withColumn("open", F.lit(True))
    for i in range(MAX_ITERATIONS + 1):
        step = _step(points, state.where("open").drop("open"), keys, count)
        ends = F.coalesce(F.abs(F.col("bound") - F.col("last")) < TOLERANCE, F.lit(False)) | F.lit(i == MAX_ITERATIONS)
        step = step.select(*keys, "cut", F.col("bound").alias("last"), *[
            F.when(ends, F.col(p)).otherwise(F.col(f"new_{p}")).alias(p) for p in _PARAMS], (~ends).alias("open"))
        before, state = state, scale.materialise(step.unionByName(state.where("NOT open")))
        scale.discard(before)
        if state.where("open").isEmpty():
            break
    low = F.col("mu0") <= F.col("mu1")
    ordered = [F.when(low, F.col(p)).otherwise(F.col(p[:-1] + "10"[int(p[-1])])).alias(p) for p in _PARAMS]
    return facts.select(*keys, "n", "mean").join(state.select(*keys, *ordered), keys).select(
        *keys, "n", "mean", F.lit(None).cast("double").alias("mid"), *_PARAMS)


def gmm_components(scores: DataFrame, task_points: int = TASK_POINTS) -> DataFrame:
    """Mixture of two Gaussians per key over the validation scores, component 1 having the larger mean.

    Keys of more than ``task_points`` distinct scores are fitted by aggregations, others in one task, by the same steps.
    Adds lo, hi and mean of the raw scores for the limit. ``mid`` holds the median where no mixture was fitted.
    """
    keys = score_keys(scores)
    val = validation_scores(scores)
    types = dict(scores.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", n bigint, mean double, mid double" + "".join(
        f", {p} double" for p in _PARAMS)
    points, large = score_counts(val, keys), None
    if val.count() > task_points:
        points = scale.materialise(points)
        sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct")).where(F.col("_distinct") > task_points)
        large = scale.materialise(sizes.select(*keys))
        if large.isEmpty():
            large = None
    small = points if large is None else scale.filter_by(points, large, keys, "left_anti")
    fitted = small.groupBy(*keys).applyInPandas(_fit_key(keys), schema)
    fitted = fitted.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c not in keys + ["n"] else F.col(c)
                             for c in fitted.columns])
    if large is not None:
        many = scale.materialise(scale.filter_by(points, large, keys))
        fitted = fitted.unionByName(_fit_large(many, keys))
        scale.discard(many)
    ends = val.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return fitted.join(ends, keys)


def separation(mu0: Column, var0: Column, mu1: Column, var1: Column) -> Column:
    return F.abs(mu0 - mu1) / (F.sqrt(var0) + F.sqrt(var1))


def first_crossing(points: int = GRID_POINTS) -> Column:
    """First of ``points`` evenly spaced values from lo to hi where component 1 is at least as likely as component 0."""
    def weighted(i, x):
        w, mu, var = F.col(f"w{i}"), F.col(f"mu{i}"), F.col(f"var{i}")
        return F.log(w) - 0.5 * F.log(var) - (x - mu) * (x - mu) / (2.0 * var)

    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * step)
    return F.try_element_at(F.filter(grid, lambda x: weighted(1, x) >= weighted(0, x)), F.lit(1))


def limits_from_components(components: DataFrame) -> DataFrame:
    """Limit and separation score per key: the first grid crossing, the mean where there is none, the median (and
    separation 0) where no mixture was fitted."""
    keys = score_keys(components)
    fitted = F.col("mu0").isNotNull()
    sep = separation(F.col("mu0"), F.col("var0"), F.col("mu1"), F.col("var1"))
    limit = F.when(fitted, F.coalesce(first_crossing(), F.col("mean"))).otherwise(F.col("mid"))
    return components.select(*keys, limit.alias("threshold_value"),
                             F.when(fitted, sep).otherwise(F.lit(0.0)).alias("separation_score"))


def gmm_limits(scores: DataFrame, task_points: int = TASK_POINTS) -> DataFrame:
    """Mixture limits per key with a validation score; DBSCAN flags need none and get none."""
    return limits_from_components(gmm_components(scores.where(F.col("model") != "DBSCAN"), task_points))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float],
                    limit: int = scale.HOT_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per key; equal values are counted first, long keys ranked in segments."""
    # Stored, so that counting what is to be ranked does not read the rows once more.
    counted = scale.materialise(rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w")))
    ranked = scale.running(counted, keys, ["v"], {"end": F.col("w")}, limit, whole={"_n": F.sum("w")})
    out, parts = [], []
    for name, q in points.items():
        at = (F.col("_n") - 1) * F.lit(q)
        low = F.floor(at)

        def holds(place):
            return (F.col("end") - F.col("w") <= place) & (place < F.col("end"))

        a = F.max(F.when(holds(low), F.col("v")))
        b = F.max(F.when(holds(F.least(low + 1, F.col("_n") - 1)), F.col("v")))
        part = F.max(at - low)
        parts += [a.alias(f"_a_{name}"), b.alias(f"_b_{name}"), part.alias(f"_p_{name}")]
        out.append((F.col(f"_a_{name}") + F.col(f"_p_{name}") * (F.col(f"_b_{name}") - F.col(f"_a_{name}")))
                   .alias(name))
    return ranked.groupBy(*keys).agg(*parts).select(*keys, *out)


def iqr_limits(scores: DataFrame, multipliers=None, limit: int = scale.HOT_ROWS) -> DataFrame:
    """Limit Q3 + k * (Q3 - Q1) of the validation scores per key, one row per multiplier k."""
    keys = score_keys(scores)
    multipliers = IQR_MULTIPLIERS if multipliers is None else multipliers
    q = exact_quantiles(validation_scores(scores), keys, "score", {"q1": 0.25, "q3": 0.75}, limit)
    k = F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))
    return q.withColumn("multiplier", k).select(
        *keys, "multiplier",
        (F.col("q3") + F.col("multiplier") * (F.col("q3") - F.col("q1"))).alias("threshold_value"),
        F.lit(0.0).alias("separation_score"))


def predict(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``predicted``: 1 above the limit of the key (0.0 where it has none); for DBSCAN, 1 for noise.

    Rows without score are predicted 0. Limits with a multiplier give one prediction per multiplier.
    """
    keys = score_keys(scores)
    rows = scale.lookup_join(scores, limits.drop("separation_score"), keys) \
        if "multiplier" not in limits.columns else _predict_all(scores, limits, keys)
    above = F.col("score") > F.coalesce("threshold_value", F.lit(0.0))
    hit = F.when(F.col("model") == "DBSCAN", F.col("score") == 1.0).otherwise(above)
    return rows.withColumn("predicted", F.coalesce(hit, F.lit(False)).cast("int"))


def _predict_all(scores, limits, keys):
    sweep = limits.groupBy(*keys).agg(F.collect_list(F.struct("multiplier", "threshold_value")).alias("_l"))
    rows = scale.lookup_join(scores, sweep, keys)
    return rows.withColumn("_l", F.explode_outer("_l")).select(*scores.columns, "_l.*")


def limit_sweeps(limits: DataFrame) -> DataFrame:
    """All limits of a key as one ascending array ``sweep`` of (threshold_value, multiplier)."""
    return limits.groupBy(*score_keys(limits)).agg(
        F.array_sort(F.collect_list(F.struct("threshold_value", "multiplier"))).alias("sweep"))


def exceeded(scores: DataFrame, limits: DataFrame, multipliers: list[float]) -> DataFrame:
    """Add ``exceeded``: how many of the key's limits, one per multiplier, lie below the score; no row is copied.

    A score predicts an anomaly for just the lowest ``exceeded`` limits of its key. Rows without score exceed none; a key
    without limits has limit 0.0 throughout; DBSCAN noise exceeds all.
    """
    rows = scale.lookup_join(scores, limit_sweeps(limits), score_keys(scores))
    every = F.lit(len(multipliers))
    passed = F.size(F.filter("sweep", lambda x: x["threshold_value"] < F.col("score")))
    hit = F.when(F.col("model") == "DBSCAN", F.when(F.col("score") == 1.0, every)).when(
        F.col("sweep").isNull(), F.when(F.col("score") > 0.0, every)).otherwise(passed)
    return rows.withColumn("exceeded", F.coalesce(hit, F.lit(0))).drop("sweep")
