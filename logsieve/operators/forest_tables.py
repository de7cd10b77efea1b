"""Isolation forests grown as tables: every level of all trees of all groups is one aggregation and one join.

Samples, split features and cuts come from md5 draws keyed by (seed, run, group, tree, node), so the same forest can be
stated in SQL and does not depend on partitioning. A level shuffles the sampled events alone, at most trees * sample rows
per group and feature set, however large the log. Growing needs one draw per training event and tree (``forest.py`` needs one per
event); its models are scored by ``forest.iforest_score``.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scale
from .forest import expected_candidates, path_length
from .levels import group_keys, run_keys
from ..functions import scalars as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sample_trees(vectors: DataFrame, trees: int, sample: int, seed: int = 7) -> DataFrame:
    """Each tree's ``sample`` training events with the least draws: keys, feature_set, tree, psi and x.

    Only events whose draw lies below a bound that leaves out no tree but by a chance of less than 1e-9 are ranked.
    """
    keys, run = [*group_keys(vectors), "feature_set"], F.col("run") if run_keys(vectors) else F.lit(0)
    share = F.lit(expected_candidates(sample)) / F.col("n_train")
    bound = F.lower(F.lpad(F.hex(F.ceil(share * float(S.HASH_RANGE)).cast("bigint")), 8, "0"))
    rows = vectors.where(F.col("split") == "train").withColumn("_bound", F.when(share < 0.5, bound))
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = "tree", seed, run, F.concat_ws("|", "event_key", "level", F.col("tree").cast("string"))
    # Draws are compared as digits; only those below the bound become numbers.
    rows = rows.where(F.col("_bound").isNull() | (S.hash_digits(*draw) < F.col("_bound"))).withColumn("_h", S.hash32(*draw))
    place = F.row_number().over(Window.partitionBy(*keys, "tree").orderBy("_h", "event_key"))
    return rows.withColumn("_place", place).where(F.col("_place") <= sample).select(
        *keys, "n", "tree", F.least(F.lit(sample), F.col("n_train")).cast("int").alias("psi"), "x")


def grow_tables(samples: DataFrame, sample: int, seed: int = 7) -> DataFrame:
    """The nodes of all trees: keys, n, feature_set, psi, tree, level, node (heap order), events, feature (null at a leaf), cut."""
    keys, run = [*group_keys(samples), "feature_set"], F.col("run") if run_keys(samples) else F.lit(0)
    at = [*keys, "tree", "node"]
    members = scale.materialise(samples.withColumn("node", F.lit(0)))
    dims = members.agg(F.max(F.size("x"))).first()[0] or 0
    name = F.concat_ws("|", "level", "g_act", "g_res", "feature_set", F.col("tree").cast("string"), F.col("node").cast("string"))
    tables, level = [], 0
    while True:
        value = [F.get("x", F.lit(i)) for i in range(dims)]
        stats = members.groupBy(*at).agg(
            F.count(F.lit(1)).alias("events"), F.first("n").alias("n"), F.first("psi").alias("psi"),
            F.array(*[F.min(v) for v in value]).alias("lo"), F.array(*[F.max(v) for v in value]).alias("hi"))
        # The least depth that tells psi events apart.
        deep = F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda d: F.pow(F.lit(2.0), d) < F.greatest("psi", F.lit(2))))
        open_ = F.filter(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.get("hi", i) > F.get("lo", i))
        stats = stats.withColumn("_open", F.when((F.col("events") > 1) & (deep > level), open_))
        pick = F.get("_open", F.floor(S.uniform("feature", seed, run, name) * F.size("_open")).cast("int"))
        stats = stats.withColumn("feature", F.when(F.size("_open") > 0, pick))
        lo, hi = (F.get(c, F.col("feature")) for c in ("lo", "hi"))
        cut = (lo.cast("double") + S.uniform("cut", seed, run, name) * (hi.cast("double") - lo.cast("double"))).cast("float")
        # Rounding must not leave a side empty: values up to the cut go left.
        stats = stats.withColumn("cut", F.when(cut >= hi, lo).otherwise(cut)).drop("_open", "lo", "hi")
        tables.append(scale.materialise(stats))
        splits = tables[-1].where("feature IS NOT NULL").select(*at, "feature", "cut")
        if level == int(np.ceil(np.log2(max(sample, 2)))) or splits.isEmpty():
            break
        right = (F.get("x", F.col("feature")) > F.col("cut")).cast("int")
        before, members = members, scale.materialise(members.join(splits, at).withColumn(
            "node", 2 * F.col("node") + 1 + right).drop("feature", "cut"))
        scale.discard(before)
        level += 1
    scale.discard(members)
    out = None
    for level, table in enumerate(tables):
        table = table.withColumn("depth", F.lit(level))
        out = table if out is None else out.unionByName(table)
    return out


def _pack(keys: list[str], trees: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = 2 ** (int(pdf["depth"].max()) + 1) - 1
        feature, value = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes), np.float32)
        at = pdf["tree"].to_numpy(), pdf["node"].to_numpy()
        inner = pdf["feature"].notna().to_numpy()
        feature[at[0][inner], at[1][inner]] = pdf["feature"].to_numpy()[inner].astype(np.int8)
        leaf = pdf["depth"].to_numpy() + path_length(pdf["events"].to_numpy())
        value[at] = np.where(inner, pdf["cut"].fillna(0).to_numpy(), leaf)
        row = [*(pdf[k].iloc[0] for k in keys), pdf["n"].iloc[0], pdf["feature_set"].iloc[0], pdf["psi"].iloc[0], nodes,
               feature.tobytes(), value.tobytes()]
        return pd.DataFrame([row], columns=[*keys, "n", "feature_set", "psi", "nodes", "feature", "value"])

    return pack


def iforest_fit_tables(vectors: DataFrame, trees: int, sample: int, seed: int = 7) -> DataFrame:
    """Models for ``forest.iforest_score`` from feature vectors with split, n and n_train: one row per group and feature set."""
    keys = group_keys(vectors)
    nodes = grow_tables(sample_trees(vectors, trees, sample, seed), sample, seed)
    types = dict(vectors.dtypes)
    schema = (", ".join(f"{k} {types[k]}" for k in keys)
              + ", n bigint, feature_set string, psi int, nodes int, feature binary, value binary")
    return scale.materialise(nodes.groupBy(*keys, "feature_set").applyInPandas(_pack(keys, trees), schema))
