"""Queries that pass through the stores: what is written to the shared folder is read back and held against SQL.

Also the score limits of groups too small for a mixture, and the jitter draws.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import oracles as O
from . import queries as Q
from .fixtures import fixture
from ..functions import scalars as S
from ..operators import levels, scale
from ..operators import thresholds as T
from ..sources.readers import read_report, read_scores
from ..sources.sinks import write_log_once, write_report, write_scores

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def _folder(spark) -> str:
    return f"{scale.shared_dir(spark)}/logsieve/store-{uuid.uuid4().hex}"


@_add("stored_log", O.statement(O.poisoned("clicks", Q.RUNS), "SELECT run, event_key, case_id, activity, time_us, split, "
                                                              "is_true_anomaly FROM poisoned"))
def stored_log(spark, sf):
    """The prepared log, stored run by run: the second call finds the first run and makes the other."""
    root = _folder(spark)
    write_log_once(spark, root, "clicks", Q.RUNS[:1], lambda runs: Q.poisoned(spark, sf, runs=runs))
    log = write_log_once(spark, root, "clicks", Q.RUNS, lambda runs: Q.poisoned(spark, sf, runs=runs))
    return log.select("run", "event_key", "case_id", "activity", "time_us", "split", "is_true_anomaly")


@_add("stored_scores", O.statement(O.z_scores("clicks", Q.RUNS), "SELECT 'clicks' AS dataset, run, model, level, g_act, g_res, "
                                                                 "feature_set, event_key, split, score FROM scores"))
def stored_scores(spark, sf):
    """Scores of two datasets' names, stored by (dataset, run, model, level), one read back."""
    root, scores = _folder(spark), Q.z_scores(spark, sf)
    for name in ("other", "clicks"):
        write_scores(scores.withColumn("dataset", F.lit(name)), root)
    return read_scores(spark, root, ["clicks"]).select(
        "dataset", "run", "model", "level", "g_act", "g_res", "feature_set", "event_key", "split", "score")


@_add("stored_report", Q.profile_sql("clicks_gaps", list(levels.LEVELS)))
def stored_report(spark, sf):
    """The profile of all levels as a CSV report and back."""
    path, table = _folder(spark), Q.profile_of(spark, sf, "clicks_gaps", list(levels.LEVELS))
    write_report(table, path)
    return read_report(spark, path, ", ".join(f"{c} {t}" for c, t in table.dtypes))


@_add("few_score_limits", O.statement(
    O.z_scores("clicks_fine", Q.RUNS),
    f"SELECT {O.SKEY}, {O.rnd('median(score)', 8)} AS threshold_value, 0.0::DOUBLE AS separation_score FROM scores WHERE split = 'val' "
    f"AND model <> 'DBSCAN' GROUP BY {O.SKEY} HAVING count(*) <= {T.FEW_SCORES}"))
def few_score_limits(spark, sf):
    """Limits of the keys with too few validation scores for a mixture: their median."""
    scores = Q.z_scores(spark, sf, "clicks_fine")
    keys = O.SKEY.split(", ")
    few = T.validation_scores(scores).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= T.FEW_SCORES)
    limits = T.gmm_limits(scale.filter_by(scores, few, keys))
    return limits.select(*keys, Q.r("threshold_value", 8), "separation_score")


_U = "({} / 4294967296.0::DOUBLE)"
_RADIUS = f"sqrt(-2.0::DOUBLE * ln(({O.h32('score|delta_t:r', '0')} + 1) / 4294967297.0::DOUBLE))"
_ANGLE = f"cos(2 * {O.PI}::DOUBLE * {_U.format(O.h32('score|delta_t:a', '0'))})"


@_add("jitter_draws", O.statement([("log", O.SQL["clicks"])], f"SELECT event_key, {O.rnd(f'{_RADIUS} * {_ANGLE}')} AS jitter FROM log"))
def jitter_draws(spark, sf):
    """The standard normal draws behind the jitter of scaled features, one per event."""
    draw = S.normal("score|delta_t", 7, F.lit(0), F.col("event_key"))
    return fixture(spark, sf, "clicks").select("event_key", (F.round(draw, 6) + F.lit(0.0)).alias("jitter"))
