"""Isolation forests per group (Liu, Ting and Zhou, 2008).

Each tree draws its own uniform sample of all training events of its group, independent of the other trees. An event
enters each tree's candidates with one small probability, decided by its hash, and a tree keeps the ``sample`` candidates
with the least draws; so a group sends a bounded number of events to fitting at every size, without sorting. Scoring
brings each forest to blocks of its group's events; large groups are spread over many blocks.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scale
from .levels import FEATURE_SETS, features_of, group_keys

TREES = 200
SAMPLE = 256
BLOCK_ROWS = 100_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def path_length(n):
    """Average depth of an unsuccessful search in a binary tree of n events: c(n)."""
    n = np.asarray(n, dtype=np.float64)
    more = np.maximum(n, 3)
    c = 2.0 * (np.log(more - 1.0) + np.euler_gamma) - 2.0 * (more - 1.0) / more
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, c))


def tree_depth(size):
    return int(np.ceil(np.log2(max(size, 2))))


def expected_candidates(sample):
    """Mean number of candidates per tree: too few to fill a sample less than once in a thousand million trees."""
    return sample + 8.0 * sample ** 0.5 + 16.0


def _mix(x):
    """SplitMix64 finaliser: 64-bit hashes of 64-bit integers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_samples(u, h, n, trees, sample, expected):
    """Rows of each tree's sample, [trees, min(sample, n)], of the group's ``n`` training events; None if a tree has too
    few candidates.

    ``u`` (uniform) and ``h`` (64 bits) are the draws of the events given; those left out are in no
    tree. The number of trees an event is a candidate of is Poisson, read from u, and the trees are
    drawn evenly: by the splitting of Poisson draws each event is then a candidate of each tree independently.
    """
    size = min(sample, n)
    h = h.astype(np.uint64)
    if expected >= n / 2:
        # As many candidates as events: all of them for every tree.
        row, tree = np.tile(np.arange(len(h)), trees), np.repeat(np.arange(trees), len(h))
    else:
        rate = -np.log1p(-expected / n) * trees
        # Least count whose upper tail is at most u: 1 - u takes the place of the distribution function.
        count, term = np.zeros(len(u), np.int64), np.exp(-rate)
        tail, k = -np.expm1(-rate), 0
        while (more := u < tail).any() and k < 40 * trees:
            count[more] += 1
            k += 1
            term *= rate / k
            tail -= term
        row = np.repeat(np.arange(len(h)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        tree = (_mix(h[row] + _mix(nth.astype(np.uint64))) % np.uint64(trees)).astype(np.int64)
        once = np.unique(row * trees + tree)
        row, tree = once // trees, once % trees
    draw = _mix(h[row] ^ _mix(tree.astype(np.uint64) + np.uint64(1 << 32)))
    order = np.lexsort((row, draw, tree))
    row, tree = row[order], tree[order]
    first = np.searchsorted(tree, np.arange(trees + 1))
    if (np.diff(first) < size).any():
        return None
    return row[first[:-1, None] + np.arange(size)]


def grow(points, draws, depth, rng):
    """Grow all trees of a forest at once, level by level; ``draws`` holds the rows of each tree's sample.

    Returns two [trees, nodes] arrays in heap order: the split feature (-1 at a leaf) and the split threshold, or at
    a leaf its path length.
    """
    d = points.shape[1]
    trees, size = draws.shape
    nodes = 2 ** (depth + 1) - 1
    feature = np.full(trees * nodes, -1, np.int8)
    value = np.zeros(trees * nodes, np.float32)
    member = draws.ravel()
    at = np.repeat(np.arange(trees, dtype=np.int64) * nodes, size)
    for level in range(depth + 1):
        if not len(member):
            break
        order = np.argsort(at, kind="stable")
        member, at = member[order], at[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[start, len(at)])
        node = at[start]
        x = points[member]
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        open_ = high > low
        splits = open_.any(axis=1) & (count > 1) & (level < depth)
        value[node[~splits]] = level + path_length(count[~splits])
        if not splits.any():
            break
        pick = np.where(open_, rng.random((len(node), d)), -1.0).argmax(axis=1)
        which = np.arange(len(node))
        lo, hi = low[which, pick], high[which, pick]
        cut = (lo + rng.random(len(node)).astype(np.float32) * (hi - lo)).astype(np.float32)
        # Rounding must not leave a side empty: values up to the cut go left.
        cut = np.where(cut >= hi, lo, cut)
        feature[node[splits]] = pick[splits]
        value[node[splits]] = cut[splits]
        owner = np.repeat(which, count)
        going = splits[owner]
        member, at, owner = member[going], at[going], owner[going]
        right = points[member, pick[owner]] > cut[owner]
        tree = at // nodes
        at = tree * nodes + 2 * (at - tree * nodes) + 1 + right
    return feature.reshape(trees, nodes), value.reshape(trees, nodes)


def depth_score(points, feature, value, sample, rows_at_once=4_096, cells=32_768):
    """2 ** (-mean path length / c(sample)) of each point.

    Leaves hand their path length down to the last level, so every point takes the same number of steps and several
    trees are walked in one array operation.
    """
    if points.shape[1] == 1:
        # On a line the score changes at cuts alone, so fewer cuts than points answer for all.
        cuts = np.unique(value[feature >= 0])
        if len(cuts) + 1 < len(points) and not np.isnan(points).any():
            steps = np.append(cuts, np.inf).astype(value.dtype)[:, None]
            return depth_score(steps, feature, value, sample, rows_at_once, cells)[np.searchsorted(cuts, points[:, 0])]
    trees, nodes = feature.shape
    depth = int(np.log2(nodes + 1)) - 1
    final, leaf = value.copy(), feature < 0
    for level in range(depth):
        above, below = (slice(2 ** n - 1, 2 ** (n + 1) - 1) for n in (level, level + 1))
        ended = np.repeat(leaf[:, above], 2, axis=1)
        final[:, below] = np.where(ended, np.repeat(final[:, above], 2, axis=1), final[:, below])
        leaf[:, below] |= ended
    final, cut = final.ravel(), value.ravel()
    norm = max(float(path_length(sample)), 1e-12)
    out = np.empty(len(points))
    for first in range(0, len(points), rows_at_once):
        block = np.ascontiguousarray(points[first:first + rows_at_once].T)
        m = block.shape[1]
        flat, row = block.ravel(), np.arange(m)
        column = (np.maximum(feature, 0).astype(np.intp) * m).ravel()
        total = np.zeros(m)
        step = max(1, cells // m)
        for t in range(0, trees, step):
            root = (np.arange(t, min(t + step, trees)) * nodes)[:, None]
            node = np.repeat(root, m, axis=1)
            # Arrays are used again at every step; no place lies outside, so "clip" only saves looking.
            place, right = np.empty_like(node), np.empty(node.shape, bool)
            x, bound = np.empty(node.shape, flat.dtype), np.empty(node.shape, cut.dtype)
            for _ in range(depth):
                np.take(column, node, out=place, mode="clip")
                place += row
                np.take(flat, place, out=x, mode="clip")
                np.take(cut, node, out=bound, mode="clip")
                np.greater(x, bound, out=right)
                node += node
                node -= root - 1
                node += right
            total += final[node].sum(axis=0, dtype=np.float64)
        out[first:first + rows_at_once] = np.exp2(-total / trees / norm)
    return out


def distinct(points):
    """The different rows and the place of every row among them, so that equal ones walk the trees once."""
    points = np.ascontiguousarray(points)
    rows = points.view(np.dtype((np.void, points.itemsize * points.shape[1]))).ravel()
    _, first, place = np.unique(rows, return_index=True, return_inverse=True)
    return points[first], place.ravel()


def iforest_fit(scaled: DataFrame, feature_sets: dict = FEATURE_SETS, trees: int = TREES, sample: int = SAMPLE,
                seed: int = 7) -> DataFrame:
    """Fit one forest per group and feature set; returns the stored models.

    ``scaled`` has one row per event and level with the scaled features, split, n and n_train. Should a tree find too few
    candidates, which chance all but excludes, all are drawn again with twice as many.
    """
    keys = group_keys(scaled)
    run = F.col("run") if "run" in scaled.columns else F.lit(0)
    names = features_of(feature_sets)
    types = dict(scaled.dtypes)
    schema = (", ".join(f"{k} {types[k]}" for k in keys)
              + ", n bigint, feature_set string, psi int, nodes int, feature binary, value binary")
    key = F.concat_ws("|", "event_key", "level")
    # 52 bits of an md5, so that even a group of 10 ** 12 events has draws fine enough; the hash for all other draws.
    text = F.concat_ws("|", F.lit(f"forest:{seed}"), run.cast("string"), key)
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    h = F.xxhash64(F.lit(f"trees:{seed}"), run, key)
    expected = expected_candidates(sample)
    train = scaled.where(F.col("split") == "train").select(
        *keys, "n", "n_train", "event_key", *names, u.alias("_u"), h.alias("_h"))
    while True:
        # Chance of no tree at all left out; a group no larger than twice the candidates comes whole.
        share = F.lit(expected) / F.col("n_train")
        some = F.when(share < 0.5, -F.expm1(F.log1p(-share) * trees)).otherwise(F.lit(1.0))
        fit = _fit_group(keys, feature_sets, names, trees, sample, expected, seed)
        model = scale.materialise(train.where(F.col("_u") < some).groupBy(*keys).applyInPandas(fit, schema))
        if model.where("psi IS NULL").isEmpty():
            return model
        scale.discard(model)
        expected *= 2


def _fit_group(keys, feature_sets, names, trees, sample, expected, seed):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # In the group's own content order, so the forest does not depend on partitioning.
        pdf = pdf.sort_values("event_key")
        x = pdf[names].to_numpy(np.float32)
        group, n = [pdf[k].iloc[0] for k in keys], int(pdf["n"].iloc[0])
        label = "|".join(map(str, group))
        draws = tree_samples(pdf["_u"].to_numpy(np.float64), pdf["_h"].to_numpy(np.int64), int(pdf["n_train"].iloc[0]), trees,
                             sample, expected)
        out = []
        for i, (name, cols) in enumerate(feature_sets.items()):
            if draws is None:
                out.append([*group, n, name, None, None, None, None])
                continue
            size = draws.shape[1]
            rng = np.random.default_rng([seed, i, *label.encode()])
            points = np.ascontiguousarray(x[:, [names.index(c) for c in cols]])
            feature, value = grow(points, draws, tree_depth(size), rng)
            out.append([*group, n, name, size, feature.shape[1], feature.tobytes(), value.tobytes()])
        out = pd.DataFrame(out, columns=[*keys, "n", "feature_set", "psi", "nodes", "feature", "value"])
        return out.astype({"psi": "Int32", "nodes": "Int32"})

    return fit


def iforest_score(scaled: DataFrame, model: DataFrame, feature_sets: dict = FEATURE_SETS,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Anomaly score in (0, 1) of every event for every feature set; higher is more anomalous.

    Returns the input without its features, with feature_set, score and model.
    """
    keys = group_keys(scaled)
    names = features_of(feature_sets)
    keep = [c for c in scaled.columns if c not in names]
    # The group size is known since scaling, to the events and to the model alike.
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    rows = scaled.withColumn("_part", F.pmod(F.xxhash64("event_key"), parts).cast("int"))
    models = model.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    by = [*keys, "_part"]
    types = dict(scaled.dtypes)
    scores = [f"score_{i}" for i in range(len(feature_sets))]
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + "".join(f", {s} double" for s in scores)
    score = _score_block(keep, names, feature_sets, scores)
    wide = rows.groupBy(*by).cogroup(models.groupBy(*by)).applyInPandas(score, schema)
    pairs = ", ".join(f"'{n}', {s}" for n, s in zip(feature_sets, scores))
    return wide.select(*keep, F.expr(f"stack({len(feature_sets)}, {pairs}) AS (feature_set, score)"),
                       F.lit("IsolationForest").alias("model"))


def _score_block(keep, names, feature_sets, scores):
    def score(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = rows[keep].copy()
        x = rows[names].to_numpy(np.float32)
        found = {m.feature_set: m for m in models.itertuples()}
        for s, (name, cols) in zip(scores, feature_sets.items()):
            m = found.get(name)
            if m is None or not len(rows):
                out[s] = np.nan
                continue
            feature = np.frombuffer(m.feature, np.int8).reshape(-1, m.nodes)
            value = np.frombuffer(m.value, np.float32).reshape(-1, m.nodes)
            points, place = distinct(x[:, [names.index(c) for c in cols]])
            out[s] = depth_score(points, feature, value, m.psi)[place]
        return out

    return score
