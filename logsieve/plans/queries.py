"""The registered queries: each operator on whole test tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracles as O
from .fixtures import SQL, fixture
from ..operators import compare as C
from ..operators import context as X
from ..operators import density as D
from ..operators import evaluate as E
from ..operators import features as B
from ..operators import histogram as H
from ..operators import forest, forest_tables, inject, levels, order, profile, scale, split
from ..operators import thresholds as T
from ..sources.readers import parse_utc, unpivot_scores
from ..sources.sinks import wide_scores

QUERIES, ORACLES = {}, {}
RUNS = [1, 2]
SWEEP = [0.0, 1.5]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(c, n: int = 6):
    return (F.round(c, n) + F.lit(0.0)).alias(c)


def rs(c: str, n: int = 6) -> str:
    return f"{O.rnd(c, n)} AS {c}"


def squash(c, n: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.signum(c) * F.log(1 + F.abs(c)), n) + F.lit(0.0)


# ---- logs ---------------------------------------------------------------------------------------------------------

def ordered(spark, sf, name="clicks"):
    return order.order_events(fixture(spark, sf, name))


def cut(spark, sf, name="clicks"):
    return split.split(ordered(spark, sf, name), "cases" if name == "orders" else "rows")


def poisoned(spark, sf, name="clicks", runs=None):
    # Stored once ordered: cutting and marking scan it several times.
    log = scale.materialise(ordered(spark, sf, name))
    log = split.split(log, "cases" if name == "orders" else "rows")
    return inject.inject_anomalies(log, runs=RUNS if runs is None else runs)


def feats(spark, sf, name="clicks", poison=True, runs=None):
    return B.base_features(poisoned(spark, sf, name, runs) if poison else cut(spark, sf, name))


@query("log_canonical", O.statement([("log", SQL["lines"])], "SELECT event_key, case_id, activity, resource, time_us "
                                                             "FROM log"))
def log_canonical(spark, sf):
    return fixture(spark, sf, "lines").select("event_key", "case_id", "activity", "resource", "time_us")


@query("parse_mixed_times", "SELECT o_orderkey, epoch_us(o_orderdate) + o_orderkey % 86400 * 1000000 AS time_us FROM orders")
def parse_mixed_times(spark, sf):
    """Order times written in nine notations by the order key, and read back."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.timestamp_add(
        "SECOND", F.col("o_orderkey") % 86_400, F.col("o_orderdate").cast("timestamp_ntz")).alias("t"))

    def text(pattern, t="t"):
        return F.date_format(t, pattern)

    number = F.col("o_orderkey") % 9
    written = (F.when(number == 0, text("yyyy-MM-dd HH:mm:ss.SSSSSS")).when(number == 1, text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(number == 2, text("MM/dd/yyyy HH:mm:ss"))
               .when(number == 3, F.when(F.dayofmonth("t") > 12, text("dd.MM.yyyy HH:mm:ss"))
                     .otherwise(text("MM.dd.yyyy HH:mm:ss")))
               .when(number == 4, F.concat(text("yyyy-MM-dd HH:mm:ss", F.expr("t + INTERVAL 2 HOURS")), F.lit("+02")))
               .when(number == 5, text("MM/dd/yyyy hh:mm:ss a"))
               .when(number == 6, text("d-MMM-yyyy HH:mm:ss"))
               .when(number == 7, text("MMMM d, yyyy h:mm:ss a"))
               .otherwise(F.concat(text("yyyyMMdd HH:mm:ss"), F.lit(" UTC"))))
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return rows.select("o_orderkey", F.timestamp_diff("MICROSECOND", epoch, parse_utc(written)).alias("time_us"))


@query("event_sequence", O.statement(O.ordered("lines"), "SELECT event_key, case_id, CAST(event_seq AS BIGINT) AS "
                                     "event_seq, CAST(trace_len AS BIGINT) AS trace_len, case_start_us FROM ordered"))
def event_sequence(spark, sf):
    return ordered(spark, sf, "lines").select("event_key", "case_id", "event_seq", "trace_len", "case_start_us")


# ---- profile ------------------------------------------------------------------------------------------------------

_PROFILE_GROUPS = {"L3_Global": None, "L2_Activity": "activity", "L1_Micro": "activity, resource"}


def profile_sql(fix: str, which: list[str]) -> str:
    base = [*O.ordered(fix), ("gaps", "SELECT *, coalesce(time_us - lag(time_us) OVER (PARTITION BY case_id ORDER BY "
                                      "event_seq), 0) / 1e6::DOUBLE AS d FROM ordered")]
    rows = []
    for lv in which:
        by = _PROFILE_GROUPS[lv]
        keep = " AND ".join(f"{c} IS NOT NULL" for c in by.split(", ")) if by else "true"
        ok = "true" if lv == "L3_Global" else "n >= 30"

        def mean(c):
            return f"coalesce(avg(CASE WHEN {ok} THEN coalesce({c}, 0) END), 0)"

        rows.append(f"""SELECT '{lv}' AS level,
            (SELECT count(DISTINCT activity) FROM log) AS distinct_activities,
            (SELECT count(DISTINCT resource) FROM log) AS distinct_resources,
            count(*) AS num_models, (SELECT count(*) FROM log) AS total_events,
            {O.rnd('avg(n)', 4)} AS avg_events_per_model, CAST(median(n) AS DOUBLE) AS median_events_per_model,
            count(*) FILTER (n < 30) AS models_dropped_under_30,
            {O.rnd('coalesce(sum(n) FILTER (n < 30), 0) / (SELECT count(*) FROM log)::DOUBLE * 100', 4)}
                AS percent_events_dropped,
            {O.rnd(mean('v') + ' / 1e6::DOUBLE', 3)} AS avg_delta_t_variance,
            {O.rnd(f'sqrt({mean("v")}) / 3600', 4)} AS avg_delta_t_std_hours,
            {O.rnd(mean('m') + ' / 3600', 4)} AS avg_delta_t_mean_hours,
            {O.rnd(mean('lo') + ' / 3600', 4)} AS avg_delta_t_min_hours,
            {O.rnd(mean('hi') + ' / 3600', 4)} AS avg_delta_t_max_hours
            FROM (SELECT count(*) AS n, var_samp(d) AS v, avg(d) AS m, min(d) AS lo, max(d) AS hi FROM gaps
                  WHERE {keep} {'GROUP BY ' + by if by else ''})""")
    return O.statement(base, " UNION ALL ".join(rows))


def profile_of(spark, sf, name, which):
    table = profile.profile(fixture(spark, sf, name), which)
    # Variances reach 1e10 square seconds; in million square seconds their digits are comparable.
    table = table.withColumn("avg_delta_t_variance", F.col("avg_delta_t_variance") / 1e6)
    digits = {"avg_delta_t_variance": 3, "median_events_per_model": 6}
    return table.select(*[r(c, digits.get(c, 4)) if t == "double" else F.col(c) for c, t in table.dtypes])


for _n, _fix, _lv in (("profile_l3_global", "clicks", ["L3_Global"]), ("profile_l2_activity", "lines", ["L2_Activity"]),
                      ("profile_l1_micro", "clicks_gaps", ["L1_Micro"]),
                      ("profile_all_levels", "lines", list(_PROFILE_GROUPS))):
    query(_n, profile_sql(_fix, _lv))(lambda spark, sf, f=_fix, lv=_lv: profile_of(spark, sf, f, lv))


# ---- features -----------------------------------------------------------------------------------------------------

def feature_query(name: str, cols: dict, fix: str = "clicks", poison: bool = False):
    """``cols``: feature -> decimals, or None for an integer or text feature."""
    base = O.poisoned(fix, RUNS) if poison else O.split(fix)
    ids = ["run", "event_key"] if poison else ["event_key"]
    types = {"event_idx": "BIGINT", "trace_len": "BIGINT", "act_rework_count": "BIGINT", "weekday": "INTEGER"}
    outs = [rs(c, n) if n is not None else (f"CAST({c} AS {types[c]}) AS {c}" if c in types else c)
            for c, n in cols.items()]
    sql = O.statement(O.features(base, "poisoned" if poison else "cut"),
                      f"SELECT {', '.join([*ids, *outs])} FROM feats")

    def run(spark, sf):
        df = feats(spark, sf, fix, poison)
        return df.select(*ids, *[F.col(c) if n is None else r(c, n) for c, n in cols.items()])

    query(name, sql)(run)


feature_query("feat_delta_t", {"delta_t": 6}, poison=True)
feature_query("feat_cum_t", {"cum_t": 6}, "lines")
feature_query("feat_trace_pos", {"trace_len": None, "event_idx": None, "trace_pos": 6}, "lines")
feature_query("feat_rework", {"act_rework_count": None}, poison=True)
feature_query("feat_momentum", {"rolling_delta_t_mean": 7, "momentum_ratio": 3})
feature_query("feat_transition", {"prev_act": None, "activity": None}, poison=True)
feature_query("feat_cyclical", {"hour_sin": 6, "hour_cos": 6, "day_sin": 6, "day_cos": 6, "hour_linear": 6,
                                "day_linear": 6, "weekday": None})
feature_query("feat_density", {"event_density": 6}, "lines")


def workload_sql(fix):
    return O.statement(O.context(O.features(O.split(fix), "cut"), False, True, []),
                       "SELECT event_key, resource_workload FROM ctx")


@query("feat_resource_workload", workload_sql("clicks_gaps"))
def feat_resource_workload(spark, sf):
    return X.resource_workload(fixture(spark, sf, "clicks_gaps")).select("event_key", "resource_workload")


@query("feat_workload_ties", workload_sql("lines"))
def feat_workload_ties(spark, sf):
    return X.resource_workload(fixture(spark, sf, "lines")).select("event_key", "resource_workload")


# ---- splits and injection -----------------------------------------------------------------------------------------

@query("split_by_rows", O.statement(O.split("lines"), "SELECT event_key, split FROM cut"))
def split_by_rows(spark, sf):
    return split.split_by_rows(fixture(spark, sf, "lines")).select("event_key", "split")


@query("split_by_cases", O.statement(O.split("orders", "cases"), "SELECT event_key, split FROM cut"))
def split_by_cases(spark, sf):
    return cut(spark, sf, "orders").select("event_key", "split")


@query("chronological_position", O.statement([("log", SQL["lines"])], "SELECT event_key, row_number() OVER (ORDER BY "
                                             "time_us, event_key) - 1 AS position FROM log"))
def chronological_position(spark, sf):
    return split.chronological_position(fixture(spark, sf, "lines")).select("event_key", "position")


@query("sample_exact_n", O.statement(
    [("log", SQL["lines"]), ("r", "SELECT * FROM log CROSS JOIN (VALUES (1), (2)) AS r(run)")],
    f"SELECT run, event_key FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY {O.h32('sample')}, event_key) "
    "<= 1000"))
def sample_exact_n(spark, sf):
    rows = inject.with_runs(fixture(spark, sf, "lines").select("event_key"), RUNS)
    return rows.where(inject.smallest(rows, 1000, RUNS, "sample", 7)).select("run", "event_key")


_INJECTED = O.poisoned("clicks", RUNS)


@query("inject_labels", O.statement(_INJECTED, "SELECT run, event_key, activity_label, time_label, is_true_anomaly "
                                               "FROM poisoned"))
def inject_labels(spark, sf):
    return poisoned(spark, sf).select("run", "event_key", "activity_label", "time_label", "is_true_anomaly")


@query("inject_activity", O.statement(_INJECTED, "SELECT run, event_key, activity, activity_label FROM poisoned"))
def inject_activity(spark, sf):
    return poisoned(spark, sf).select("run", "event_key", "activity", "activity_label")


@query("inject_time", O.statement(_INJECTED, "SELECT run, event_key, time_us, epoch_us(time) AS moved_us, event_seq "
                                             "FROM poisoned"))
def inject_time(spark, sf):
    from ..functions.scalars import micros
    return poisoned(spark, sf).select("run", "event_key", "time_us", micros("time").alias("moved_us"), "event_seq")


# ---- context ------------------------------------------------------------------------------------------------------

def context_query(name: str, grain: str, fix: str):
    _, _, expected, z = X.GRAINS[grain]
    cols = [f"expected_{expected}", f"z_score_{z}"]
    base = O.features(O.split(fix, "cases" if fix == "orders" else "rows"), "cut")
    query(name, O.statement(O.context(base, False, fix != "orders", [grain]),
                            f"SELECT event_key, {rs(cols[0], 4)}, {O.squash(cols[1])} AS {cols[1]} FROM ctx"))(
        lambda spark, sf: _context_of(spark, sf, fix, [grain]).select(
            "event_key", r(cols[0], 4), squash(cols[1]).alias(cols[1])))


def _context_of(spark, sf, fix, grains):
    f = feats(spark, sf, fix, poison=False)
    return X.apply_context_stats(f, X.fit_context_stats(f, grains), grains)


for _n, _g, _fix in (("ctx_activity", "activity", "clicks"), ("ctx_transition", "transition", "lines"),
                     ("ctx_act_day", "act_day", "clicks"), ("ctx_resource", "resource", "clicks_gaps"),
                     ("ctx_micro", "micro", "lines"), ("ctx_res_day", "res_day", "clicks_gaps"),
                     ("ctx_act_res_day", "act_res_day", "clicks_fine"), ("ctx_cum_t", "cum_t", "lines")):
    context_query(_n, _g, _fix)

_CTX = [c for g in X.GRAINS.values() for c in (f"expected_{g[2]}", f"z_score_{g[3]}")]


def _ctx_sql(c):
    return rs(c, 4) if c.startswith("expected") else f"{O.squash(c)} AS {c}"


def _ctx_col(c):
    return r(c, 4) if c.startswith("expected") else squash(c).alias(c)


@query("ctx_no_resource", O.statement(
    O.context(O.features(O.split("orders", "cases"), "cut"), False, False),
    f"SELECT event_key, resource_workload, {', '.join(map(_ctx_sql, _CTX))} FROM ctx"))
def ctx_no_resource(spark, sf):
    return X.context_features(feats(spark, sf, "orders", poison=False)).select(
        "event_key", "resource_workload", *map(_ctx_col, _CTX))


@query("ctx_all_features", O.statement(
    O.context(O.features(_INJECTED, "poisoned"), True),
    f"SELECT run, event_key, resource_workload, {', '.join(map(_ctx_sql, _CTX))} FROM ctx"))
def ctx_all_features(spark, sf):
    return X.context_features(feats(spark, sf)).select(
        "run", "event_key", "resource_workload", *map(_ctx_col, _CTX))


def _stats_sql():
    parts = O.features(O.poisoned("clicks", RUNS), "poisoned")
    rows = []
    for g, (keys, value, *_) in X.GRAINS.items():
        cols = ", ".join(c if c in keys else f"CAST(NULL AS {'VARCHAR' if c in ('activity', 'prev_act', 'resource') else 'BIGINT'}) AS {c}"
                         for c in X.KEY_COLUMNS)
        rows.append(f"SELECT run, '{g}' AS grain, {cols}, count(*) AS n, {O.rnd(f'avg({value})', 4)} AS mean, "
                    f"{O.rnd(f'coalesce(stddev_samp({value}), 0)', 4)} AS std FROM feats WHERE split = 'train' "
                    f"GROUP BY run, {', '.join(keys)}")
    return O.statement(parts, f"SELECT run, grain, activity, prev_act, CAST(weekday AS INTEGER) AS weekday, resource, "
                              f"CAST(event_idx AS BIGINT) AS event_idx, n, mean, std FROM ({' UNION ALL '.join(rows)})")


@query("context_stats", _stats_sql())
def context_stats(spark, sf):
    s = X.fit_context_stats(feats(spark, sf))
    return s.select(*[r(c, 4) if c in ("mean", "std") else F.col(c) for c in s.columns])


# ---- levels and vectors -------------------------------------------------------------------------------------------

def grouped(spark, sf, features, fix="clicks", which=levels.LEVELS):
    """Unpoisoned features at the given levels; of the features of events only those asked for are carried along."""
    f = feats(spark, sf, fix, poison=False)
    kept = {"event_key", "split", "time_us", *X.KEY_COLUMNS, "delta_t", "cum_t", *features}
    return levels.with_levels(X.context_features(f.select(*[c for c in f.columns if c in kept])), which)


def scaled(spark, sf, sets, fix="clicks", which=levels.LEVELS):
    chosen = {s: levels.FEATURE_SETS[s] for s in sets}
    names = levels.features_of(chosen)
    g = grouped(spark, sf, names, fix, which).select("event_key", "split", *levels.GROUP, *names)
    g = scale.materialise(g)
    ranges = scale.materialise(levels.usable_groups(levels.group_ranges(g, chosen)))
    return levels.scaled_features(g, ranges, chosen, groups=ranges.count())


def vectors(spark, sf, sets, which, fix="clicks"):
    chosen = {s: levels.FEATURE_SETS[s] for s in sets}
    return scale.materialise(levels.feature_vectors(scaled(spark, sf, sets, fix, which), chosen))


def _base(fix="clicks"):
    return O.context(O.features(O.split(fix), "cut"), False)


@query("level_groups", O.statement(O.levels(O.split("clicks_gaps"), "cut"),
                                   "SELECT level, g_act, g_res, count(*) AS n FROM grouped GROUP BY ALL"))
def level_groups(spark, sf):
    return (levels.with_levels(cut(spark, sf, "clicks_gaps")).groupBy(*levels.GROUP)
            .agg(F.count(F.lit(1)).alias("n")))


@query("min_samples_filter", O.statement(
    O.levels(O.split("clicks_fine"), "cut"),
    "SELECT level, g_act, g_res, count(*) AS n, count(*) FILTER (split = 'train') AS n_train FROM grouped GROUP BY ALL "
    "HAVING n_train >= 30 OR (level = 'L3_Global' AND n_train > 0)"))
def min_samples_filter(spark, sf):
    return levels.usable_groups(levels.group_ranges(levels.with_levels(cut(spark, sf, "clicks_fine")), {})).select(
        *levels.GROUP, "n", "n_train")


_ALL = list(levels.FEATURE_SETS)
_ALL_FEATURES = levels.features_of(levels.FEATURE_SETS)


@query("minmax_scale", O.statement(
    O.scaled(O.levels(_base()), _ALL), "SELECT event_key, level, g_act, g_res, " + ", ".join(
        f"{O.rnd(c + '::DOUBLE', 4)} AS {c}" for c in _ALL_FEATURES) + " FROM scaled"))
def minmax_scale(spark, sf):
    return scaled(spark, sf, _ALL).select("event_key", *levels.GROUP, *[
        (F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c) for c in _ALL_FEATURES])


@query("feature_vectors", O.statement(
    _base(), " UNION ALL ".join(
        f"SELECT event_key, '{s}' AS feature_set, CAST({len(cols)} AS INTEGER) AS dims, "
        + O.squash(" + ".join(f"{i + 1} * {c}::FLOAT::DOUBLE" for i, c in enumerate(cols)).join("()")) + " AS weighted FROM ctx"
        for s, cols in levels.FEATURE_SETS.items())))
def feature_vectors(spark, sf):
    rows = X.context_features(feats(spark, sf, poison=False))
    v = levels.feature_vectors(rows)
    weighted = F.aggregate(F.sequence(F.lit(1), F.size("x")), F.lit(0.0),
                           lambda acc, i: acc + i * F.element_at("x", i).cast("double"))
    return v.select("event_key", "feature_set", F.size("x").alias("dims"),
                    squash(weighted).alias("weighted"))


# ---- density detectors --------------------------------------------------------------------------------------------

def vector_sql(sets, which):
    return O.scaled(O.levels(_base(), which=which), sets)


_KD_SETS, _KD_LEVELS = ["cum_z_cum_t"], ["L2_Activity", "L1_Micro"]
_parts, _key, _x = O.neighbours(vector_sql(_KD_SETS, _KD_LEVELS), _KD_SETS, 5)


@query("knn_distance", O.statement(
    _parts, f"SELECT event_key, level, g_act, g_res, feature_set, {O.squash('kd')} AS score FROM vectors JOIN points "
            f"USING ({_key}, {_x}) JOIN kd USING ({_key}, pid)"))
def knn_distance(spark, sf):
    # Small cells, so that groups of a test table are already cut into several.
    out = D.neighbour_distance(vectors(spark, sf, _KD_SETS, _KD_LEVELS), leaf=1_024)
    return out.select("event_key", *levels.GROUP, "feature_set", squash("score").alias("score"))


_DB_SETS = ["delta_t", "delta_z_micro", "delta_cyclical"]
_parts, _key, _x = O.knee(vector_sql(_DB_SETS, ["L1_Micro"]), _DB_SETS)


@query("kdist_knee_eps", O.statement(_parts, f"SELECT {_key}, {O.rnd('eps')} AS eps FROM knee"))
def kdist_knee_eps(spark, sf):
    v = vectors(spark, sf, _DB_SETS, ["L1_Micro"])
    keys = D.vector_keys(v)
    d = D.neighbour_distance(v).select(*keys, F.col("score").alias("d"), F.lit(1).cast("bigint").alias("w"))
    return D.knee_eps(d, keys).select(*keys, r("eps"))


@query("dbscan_noise", O.statement(
    [*_parts, ("core", f"SELECT {_key}, pid, kd <= eps AS core, eps FROM kd JOIN knee USING ({_key})"),
     ("flag", f"SELECT {', '.join('a.' + c for c in _key.split(', '))}, a.qid AS pid, max(CASE WHEN a.d <= c.eps AND "
              f"c.core THEN 1 ELSE 0 END) AS near FROM pairs a JOIN core c ON a.pid = c.pid AND "
              + " AND ".join(f"a.{k} = c.{k}" for k in _key.split(", ")) + " GROUP BY ALL")],
    f"SELECT event_key, level, g_act, g_res, feature_set, CASE WHEN near = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS "
    f"score FROM vectors JOIN points USING ({_key}, {_x}) JOIN flag USING ({_key}, pid)"))
def dbscan_noise(spark, sf):
    out = D.dbscan_noise(vectors(spark, sf, _DB_SETS, ["L1_Micro"]))
    return out.select("event_key", *levels.GROUP, "feature_set", "score")


_LINE = ["delta_t"]
_LINE_KEY = "level, g_act, g_res, feature_set"


def _line_sql():
    """k-th distances on a line: the least reach of the five stretches of five sorted events that hold an event."""
    parts = O.points(vector_sql(_LINE, levels.LEVELS), _LINE)[0][:-1]
    w = f"OVER (PARTITION BY {_LINE_KEY} ORDER BY v, event_key)"
    reach = ", ".join(f"CASE WHEN lag(v, {j}) {w} IS NOT NULL AND lead(v, {4 - j}) {w} IS NOT NULL THEN "
                      f"greatest(v - lag(v, {j}) {w}, lead(v, {4 - j}) {w} - v) END" for j in range(5))
    curve = (f"SELECT {_LINE_KEY}, d, row_number() OVER (PARTITION BY {_LINE_KEY} ORDER BY d) - 1 AS i, count(*) OVER (PARTITION "
             f"BY {_LINE_KEY}) AS n, min(d) OVER (PARTITION BY {_LINE_KEY}) AS d0, max(d) OVER (PARTITION BY {_LINE_KEY}) AS d1 "
             f"FROM (SELECT {_LINE_KEY}, coalesce(kd, 0) AS d FROM kd)")
    knee = (f"SELECT {_LINE_KEY}, CASE WHEN n < 6 THEN 0.5 ELSE greatest(0.01, d) END AS eps FROM curve QUALIFY row_number() "
            f"OVER (PARTITION BY {_LINE_KEY} ORDER BY abs(i * (d1 - d0) - (d - d0) * (n - 1)) DESC, i) = 1")
    near = f"(PARTITION BY {_LINE_KEY} ORDER BY v, event_key ROWS BETWEEN"
    flags = f"SELECT *, coalesce(kd <= eps, false) AS core FROM kd JOIN knee USING ({_LINE_KEY})"
    sides = (f"SELECT *, v - last_value(CASE WHEN core THEN v END IGNORE NULLS) OVER {near} UNBOUNDED PRECEDING AND CURRENT ROW) "
             f"AS a, first_value(CASE WHEN core THEN v END IGNORE NULLS) OVER {near} CURRENT ROW AND UNBOUNDED FOLLOWING) - v "
             "AS b FROM flags")
    return [*parts, ("sorted", "SELECT *, x0::DOUBLE AS v FROM vectors"),
            ("kd", f"SELECT event_key, {_LINE_KEY}, v, least({reach}) AS kd FROM sorted"),
            ("curve", curve), ("knee", knee), ("flags", flags), ("sides", sides)]


@query("knn_distance_line", O.statement(_line_sql()[:-4], f"SELECT event_key, {_LINE_KEY}, {O.squash('kd')} AS score FROM kd"))
def knn_distance_line(spark, sf):
    out = D.neighbour_distance(vectors(spark, sf, _LINE, levels.LEVELS))
    return out.select("event_key", *levels.GROUP, "feature_set", squash("score").alias("score"))


@query("kdist_knee_line", O.statement(_line_sql()[:-2], f"SELECT {_LINE_KEY}, {O.rnd('eps')} AS eps FROM knee"))
def kdist_knee_line(spark, sf):
    v = vectors(spark, sf, _LINE, levels.LEVELS)
    keys = D.vector_keys(v)
    d = D.neighbour_distance(v).select(*keys, F.coalesce("score", F.lit(0.0)).alias("d"), F.lit(1).cast("bigint").alias("w"))
    return D.knee_eps(d, keys).select(*keys, r("eps"))


@query("dbscan_noise_line", O.statement(
    _line_sql(), f"SELECT event_key, {_LINE_KEY}, CASE WHEN core OR coalesce(a <= eps, false) OR coalesce(b <= eps, false) THEN "
                 "0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM sides"))
def dbscan_noise_line(spark, sf):
    return D.dbscan_noise(vectors(spark, sf, _LINE, levels.LEVELS)).select("event_key", *levels.GROUP, "feature_set", "score")


def _lof_sql(sets):
    parts, key, x, dist, same = O.points(vector_sql(sets, ["L1_Micro"]), sets)
    ks = ", ".join("a." + c for c in key.split(", "))
    return O.statement([
        *parts,
        ("kk", f"SELECT {key}, greatest(least(20, sum(w_train) - 1), 1) AS k FROM points GROUP BY {key}"),
        ("pairs", f"SELECT {ks}, a.pid AS qid, b.pid, b.w_train AS w, sqrt({dist}) AS d, k FROM points a JOIN points b "
                  f"ON {same} AND b.w_train > 0 JOIN kk ON "
                  + " AND ".join(f"a.{c} = kk.{c}" for c in key.split(", "))),
        ("fitp", f"SELECT p.* EXCLUDE (w), CASE WHEN p.qid = p.pid THEN w - 1 ELSE w END AS w FROM pairs p WHERE EXISTS "
                 f"(SELECT 1 FROM points r WHERE r.w_train > 0 AND r.pid = p.qid AND "
                 + " AND ".join(f"r.{c} = p.{c}" for c in key.split(", ")) + ")"),
        ("fitl", f"SELECT *, coalesce(sum(w) OVER (PARTITION BY {key}, qid ORDER BY d, pid ROWS BETWEEN UNBOUNDED "
                 "PRECEDING AND 1 PRECEDING), 0) AS before FROM fitp WHERE w > 0 QUALIFY before < k"),
        ("asks", f"SELECT *, coalesce(sum(w) OVER (PARTITION BY {key}, qid ORDER BY d, pid ROWS BETWEEN UNBOUNDED "
                 "PRECEDING AND 1 PRECEDING), 0) AS before FROM pairs QUALIFY before < k"),
        ("reach", f"SELECT {key}, qid AS pid, max(d) AS kd FROM fitl GROUP BY {key}, qid"),
        ("dens", f"SELECT {key}, qid AS pid, 1 / (sum(least(w, k - before) * greatest(kd, d)) / max(k) + 1e-10::DOUBLE) "
                 f"AS lrd FROM fitl JOIN reach USING ({key}, pid) GROUP BY {key}, qid"),
        ("lofs", f"SELECT {key}, qid AS pid, sum(least(w, k - before) * lrd) / max(k) * (sum(least(w, k - before) * "
                 f"greatest(kd, d)) / max(k) + 1e-10::DOUBLE) AS score FROM asks JOIN reach USING ({key}, pid) "
                 f"JOIN dens USING ({key}, pid) GROUP BY {key}, qid"),
    ], f"SELECT event_key, level, g_act, g_res, feature_set, {O.rnd('score', 5)} AS score FROM vectors JOIN points "
       f"USING ({key}, {x}) JOIN lofs USING ({key}, pid)")


_LOF_SETS = ["delta_z_micro", "delta_cyclical"]


@query("lof_scores", _lof_sql(_LOF_SETS))
def lof_scores(spark, sf):
    out = D.lof(vectors(spark, sf, _LOF_SETS, ["L1_Micro"]))
    return out.select("event_key", *levels.GROUP, "feature_set", r("score", 5))


@query("iforest_scores")
def iforest_scores(spark, sf):
    rows = scale.materialise(scaled(spark, sf, _ALL))
    out = forest.iforest_score(rows, forest.iforest_fit(rows))
    return out.select("event_key", *levels.GROUP, "feature_set", "score")


_FOREST_SETS, _TREES, _SAMPLE = ["delta_t", "delta_cyclical"], 20, 64


def _forest_sql():
    """The same trees, level by level, and every event's way down each of them."""
    parts = O.points(vector_sql(_FOREST_SETS, levels.LEVELS), _FOREST_SETS)[0][:-1]
    dims = range(max(len(levels.FEATURE_SETS[c]) for c in _FOREST_SETS))
    key, x = "level, g_act, g_res, feature_set", ", ".join(f"x{i}" for i in dims)
    at = f"{key}, tree, node"
    name = "concat_ws('|', level, g_act, g_res, feature_set, tree, node)"
    draw = lambda purpose: f"({O.h32(purpose, '0', name)} / 4294967296.0::DOUBLE)"

    def length(n):
        return (f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2.0::DOUBLE * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - "
                f"2.0::DOUBLE * ({n} - 1) / {n} END")

    parts += [
        ("psis", f"SELECT {key}, least({_SAMPLE}, count(*)) AS psi FROM vectors WHERE split = 'train' GROUP BY {key}"),
        ("m0", f"SELECT {key}, tree, 0 AS node, {x} FROM (SELECT *, row_number() OVER (PARTITION BY {key}, tree ORDER BY h, "
               f"event_key) AS place FROM (SELECT *, {O.h32('tree', '0', "event_key || '|' || level || '|' || tree")} AS h FROM "
               f"vectors CROSS JOIN range({_TREES}) t(tree) WHERE split = 'train')) WHERE place <= {_SAMPLE}"),
        ("e0", f"SELECT {key}, event_key, tree, 0 AS node, {x} FROM vectors CROSS JOIN range({_TREES}) t(tree)")]
    ends, last = [], 6
    for k in range(last + 1):
        lo, hi = (f"[{', '.join(f'{side}{i}' for i in dims)}]" for side in ("lo", "hi"))
        opened = ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in dims)
        parts += [
            (f"s{k}", f"SELECT {at}, count(*) AS c, " + ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in dims)
                      + f" FROM m{k} GROUP BY {at}"),
            (f"o{k}", f"SELECT *, CASE WHEN c > 1 AND len(list_filter(range(21), lambda d: pow(2, d) < greatest(psi, 2))) > {k} THEN "
                      f"list_filter([{opened}], lambda z: z IS NOT NULL) ELSE [] END AS o FROM s{k} JOIN psis USING ({key})"),
            (f"p{k}", f"SELECT *, CASE WHEN len(o) > 0 THEN o[1 + CAST(floor({draw('feature')} * len(o)) AS BIGINT)] END AS f FROM o{k}"),
            (f"q{k}", f"SELECT *, {lo}[f + 1] AS lo, {hi}[f + 1] AS hi, CAST({lo}[f + 1]::DOUBLE + {draw('cut')} * "
                      f"({hi}[f + 1]::DOUBLE - {lo}[f + 1]::DOUBLE) AS FLOAT) AS cut0 FROM p{k}"),
            (f"n{k}", f"SELECT {at}, f, CASE WHEN cut0 >= hi THEN lo ELSE cut0 END AS cut, CAST({k} + {length('c')} AS FLOAT) AS leaf "
                      f"FROM q{k}"),
            (f"m{k + 1}", f"SELECT {key}, tree, 2 * node + 1 + CASE WHEN [{x}][f + 1] > cut THEN 1 ELSE 0 END AS node, {x} FROM "
                          f"m{k} JOIN n{k} USING ({at}) WHERE f IS NOT NULL"),
            (f"e{k + 1}", f"SELECT {key}, event_key, tree, 2 * node + 1 + CASE WHEN [{x}][f + 1] > cut THEN 1 ELSE 0 END AS node, "
                          f"{x} FROM e{k} JOIN n{k} USING ({at}) WHERE f IS NOT NULL")]
        ends.append(f"SELECT {key}, event_key, leaf::DOUBLE AS leaf FROM e{k} JOIN n{k} USING ({at}) WHERE f IS NULL")
    parts.append(("ends", " UNION ALL ".join(ends)))
    return O.statement(parts, f"SELECT event_key, {key}, {O.rnd(f'pow(2.0::DOUBLE, -sum(leaf) / {_TREES} / any_value({length("psi")}))')} "
                              f"AS score FROM ends JOIN psis USING ({key}) GROUP BY event_key, {key}")


@query("iforest_tables", _forest_sql())
def iforest_tables(spark, sf):
    """20 trees of 64 events per group, grown as tables."""
    chosen = {c: levels.FEATURE_SETS[c] for c in _FOREST_SETS}
    rows = scale.materialise(scaled(spark, sf, _FOREST_SETS))
    model = forest_tables.iforest_fit_tables(levels.feature_vectors(rows, chosen), _TREES, _SAMPLE)
    out = forest.iforest_score(rows, model, chosen)
    return out.select("event_key", *levels.GROUP, "feature_set", r("score"))


# ---- scores, limits and evaluation --------------------------------------------------------------------------------

def z_scores(spark, sf, name="clicks", runs=None):
    """Long scores of the stand-in scorers, which SQL can state too."""
    grains = ["activity", "transition", "cum_t"]
    kept = ["run", "event_key", "split", "is_true_anomaly"]
    f = B.base_features(poisoned(spark, sf, name, runs)).select(*kept, *X.KEY_COLUMNS, "delta_t", "cum_t")
    f = scale.materialise(f)
    f = X.apply_context_stats(f, X.fit_context_stats(f, grains), grains)
    flag = F.when(F.abs("z_score_act") > 2, 1.0).otherwise(0.0)
    scores = {f"_s{i}": flag if c == "flag" else F.round(F.log(1 + F.abs(c)), 6) for i, c in enumerate(O.SCORERS.values())}
    # Stored as one row per event and run; every reader repeats it per level and scorer.
    f = scale.materialise(f.select(*kept, "activity", "resource", *[c.alias(n) for n, c in scores.items()]))
    entries = [F.struct(F.lit(m).alias("model"), F.lit(fs).alias("feature_set"), F.col(n).alias("score"))
               for (m, fs), n in zip(O.SCORERS, scores)]
    rows = levels.with_levels(f).select("run", *levels.GROUP, "event_key", "split", "is_true_anomaly",
                                        F.explode(F.array(*entries)).alias("_s"))
    return rows.select("*", "_s.*").drop("_s")


_SCORES = O.z_scores("clicks", RUNS)
_WIDE = [(m, lv, fs) for m, fs in O.SCORERS for lv in levels.LEVELS]


@query("scores_unpivot", O.statement(_SCORES, "SELECT run, event_key, model, level, feature_set, CASE WHEN score = 0 AND "
                                              "model <> 'DBSCAN' THEN NULL ELSE score END AS score FROM scores"))
def scores_unpivot(spark, sf):
    wide = wide_scores(z_scores(spark, sf), ["run", "event_key"], _WIDE)
    return unpivot_scores(wide, ["run", "event_key"]).select("run", "event_key", "model", "level", "feature_set", "score")


def _stand_in(limits):
    """Give the limits a separation score that SQL can state."""
    return limits.withColumn("separation_score", 2 * F.col("threshold_value"))


def judged(spark, sf, name="clicks", multipliers=None, runs=None):
    scores = z_scores(spark, sf, name, runs)
    limits = scale.materialise(_stand_in(
        T.iqr_limits(scores.where(F.col("model") != "DBSCAN"), SWEEP if multipliers is None else multipliers)))
    return scores, limits, T.predict(scores, limits)


_JUDGED = O.judged(_SCORES, SWEEP)


def swept(spark, sf):
    """Scores, limits of all multipliers, and every group's cells for each of them."""
    scores = z_scores(spark, sf)
    limits = scale.materialise(_stand_in(T.iqr_limits(scores.where(F.col("model") != "DBSCAN"))))
    ranked = T.exceeded(scores, limits, T.IQR_MULTIPLIERS)
    return scores, limits, ranked, E.sweep_confusion(ranked, limits, T.IQR_MULTIPLIERS)


_SWEPT = O.judged(_SCORES, T.IQR_MULTIPLIERS)


def _matched(df, multipliers):
    """DBSCAN rows have no limit and so no multiplier; repeat them, as the SQL does."""
    every = F.explode(F.when(F.col("multiplier").isNull(), F.array(*[F.lit(float(m)) for m in multipliers]))
                      .otherwise(F.array("multiplier")))
    return df.withColumn("_k", every).drop("multiplier").withColumnRenamed("_k", "multiplier")


@query("iqr_threshold_sweep", O.statement(
    O.judged(_SCORES, T.IQR_MULTIPLIERS), f"SELECT {O.SKEY}, multiplier, {rs('threshold_value', 11)} FROM limits"))
def iqr_threshold_sweep(spark, sf):
    limits = T.iqr_limits(z_scores(spark, sf).where(F.col("model") != "DBSCAN"))
    return limits.select(*O.SKEY.split(", "), "multiplier", r("threshold_value", 11))


_HKEY = "level, g_act, g_res, model, feature_set"


@query("score_histogram", O.statement(
    [*_SCORES, ("sized", "SELECT *, abs(score) AS s, CASE WHEN score <> 0 THEN floor(log2(abs(score))) END AS e0 FROM scores "
                         "WHERE split = 'val' AND score IS NOT NULL"),
     ("powers", "SELECT *, pow(2.0::DOUBLE, CASE WHEN pow(2.0::DOUBLE, e0) > s THEN e0 - 1 WHEN pow(2.0::DOUBLE, e0 + 1) <= s "
                "THEN e0 + 1 ELSE e0 END) AS p FROM sized"),
     ("stepped", "SELECT *, floor((s / p - 1.0::DOUBLE) * 32.0::DOUBLE) AS m FROM powers")],
    f"SELECT {_HKEY}, CASE WHEN score = 0 THEN 0.0::DOUBLE ELSE sign(score) * p * (1.0::DOUBLE + m / 32.0::DOUBLE) END AS near, "
    "CASE WHEN score = 0 THEN 0.0::DOUBLE ELSE sign(score) * p * (1.0::DOUBLE + (m + 1) / 32.0::DOUBLE) END AS far, "
    "count(*) AS n FROM stepped GROUP BY ALL"))
def score_histogram(spark, sf):
    """Histograms of every run's validation scores, merged over the runs."""
    keys = _HKEY.split(", ")
    each = H.histogram(T.validation_scores(z_scores(spark, sf)), ["run", *keys], "score")
    return H.merge(each, keys).select(*keys, "near", "far", F.col("n").cast("bigint").alias("n"))


@query("predict_labels", O.statement(
    _JUDGED, "SELECT run, level, event_key, model, feature_set, multiplier, predicted FROM predicted"))
def predict_labels(spark, sf):
    _, _, predicted = judged(spark, sf)
    return _matched(predicted, SWEEP).select("run", "level", "event_key", "model", "feature_set", "multiplier", "predicted")


@query("eligible_groups", O.statement(
    O.z_scores("clicks_fine", RUNS),
    f"SELECT {O.SKEY}, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM scores "
    "GROUP BY ALL HAVING n_val > 0 AND n_test > 0"))
def eligible_groups(spark, sf):
    return E.eligible_groups(z_scores(spark, sf, "clicks_fine"))


@query("predict_sweep", O.statement(
    _SWEPT, f"SELECT {O.SKEY}, event_key, CAST(sum(predicted) AS INTEGER) AS exceeded FROM predicted GROUP BY {O.SKEY}, event_key"))
def predict_sweep(spark, sf):
    return swept(spark, sf)[2].select(*O.SKEY.split(", "), "event_key", "exceeded")


@query("confusion_matrix", O.statement(_SWEPT, f"SELECT {O.CKEY}, multiplier, tp, fp, fn, tn FROM cm"))
def confusion_matrix(spark, sf):
    return E.confusion_of_groups(swept(spark, sf)[3]).select(*O.CKEY.split(", "), "multiplier", *E.COUNTS)


@query("threshold_summary", O.statement(
    _SWEPT, f"SELECT {O.CKEY}, multiplier, {rs('threshold_value', 12)}, {rs('separation_score', 12)} FROM cm"))
def threshold_summary(spark, sf):
    _, limits, _, groups = swept(spark, sf)
    return E.threshold_summary(groups, limits).select(
        *O.CKEY.split(", "), "multiplier", r("threshold_value", 12), r("separation_score", 12))


def metric_table(spark, sf, name="clicks", multipliers=(1.5,), runs=None):
    scores, limits, predicted = judged(spark, sf, name, multipliers, runs)
    limits, predicted = limits.drop("multiplier"), predicted.drop("multiplier")
    return E.evaluate(scores, limits, predicted, ["act", "transition", "cum_t"])


# Every (run, model, level) lists all feature sets; DBSCAN has one of them scored.
_GRID = ("SELECT * FROM metric UNION ALL SELECT run, model, level, f.feature_set, multiplier, CAST(NULL AS DOUBLE), 0, "
         "0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM metric CROSS JOIN (VALUES ('transition'), ('cum_t')) AS f(feature_set) "
         "WHERE model = 'DBSCAN'")


def metric_sql(fix, mode="rows", resource=True, runs=RUNS, multipliers=(1.5,)):
    parts = O.judged(O.z_scores(fix, runs, mode, resource), multipliers)
    return [*parts[:-1], ("metric_0", parts[-1][1]), ("metric", _GRID.replace("metric", "metric_0"))]


@query("classification_metrics", O.statement(
    metric_sql("clicks", multipliers=T.IQR_MULTIPLIERS),
    f"SELECT {O.CKEY}, multiplier, {rs('threshold_value', 12)}, {rs('separation_score', 12)}, tp, fp, fn, tn, "
    + ", ".join(rs(m) for m in O.METRIC_NAMES) + " FROM metric"))
def classification_metrics(spark, sf):
    scores, limits, _, groups = swept(spark, sf)
    return E.evaluate_groups(scores, limits, groups, ["act", "transition", "cum_t"]).select(
        *O.CKEY.split(", "), "multiplier", r("threshold_value", 12), r("separation_score", 12), *E.COUNTS,
        *[r(m) for m in O.METRIC_NAMES])


_THREE = [1, 2, 3]
# Stand-in feature sets take part under the names the comparison knows.
_RENAME = {"act": "pure_cyclical", "transition": "delta_cyclical", "cum_t": "delta_t"}
_FIXED = {n: ("ZScore", *c[1:]) for n, c in C.FIXED_CONFIGS.items()}
_BASE = {"clicks": C.BASELINE_SCORES["bpi_2012"], "orders": C.BASELINE_SCORES["large_log"],
         "small_log": C.BASELINE_SCORES["small_log"]}


def results(spark, sf):
    """Metrics over runs of two datasets, with and without resource."""
    out = None
    for name in ("clicks", "orders"):
        t = E.over_runs(metric_table(spark, sf, name, runs=_THREE)).withColumn("dataset", F.lit(f"{name}.csv"))
        out = t if out is None else out.unionByName(t)
    return scale.materialise(out.replace(_RENAME, subset=["feature_set"]))


def _results_sql():
    parts = []
    for name in ("clicks", "orders"):
        chain = metric_sql(name, "cases" if name == "orders" else "rows", name != "orders", _THREE)
        parts.append((f"of_{name}", O.statement(O.averaged(chain, f"{name}.csv"), "SELECT * FROM table_r")))
    swap = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _RENAME.items())
    return [*parts, ("results", f"SELECT * REPLACE (CASE feature_set {swap} END AS feature_set) FROM (SELECT * FROM "
                                "of_clicks UNION ALL SELECT * FROM of_orders)")]


_RESULTS = _results_sql()
_STATS = [f"{m}_{s}" for m in O.METRIC_NAMES for s in ("mean", "std")]


@query("metrics_over_runs", O.statement(
    _RESULTS, f"SELECT dataset, model, level, feature_set, {rs('threshold_value_mean', 5)}, {rs('separation_score', 5)}, "
    + ", ".join(rs(c) for c in _STATS) + " FROM results"))
def metrics_over_runs(spark, sf):
    return results(spark, sf).select("dataset", "model", "level", "feature_set", r("threshold_value_mean", 5),
                                     r("separation_score", 5), *[r(c) for c in _STATS])


def _mixed(m):
    return f"{m}_normal_mean * 0.9::DOUBLE + {m}_anomalous_mean * 0.1::DOUBLE"


_PICKED = [*_RESULTS,
           ("cand", "SELECT *, replace(lower(dataset), '.csv', '') AS ds_clean, "
                    f"{_mixed('precision')} AS average_precision, {_mixed('recall')} AS average_recall, "
                    f"{_mixed('f1_score')} AS average_f1 FROM results WHERE model = 'ZScore' AND level <> 'L1_Micro'")]


def _best(by):
    return ("SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY ds_clean ORDER BY "
            f"{by} DESC NULLS LAST, model, level, feature_set) = 1")


_PICKED += [("best_f1", _best("f1_score_anomalous_mean")), ("best_sep", _best("separation_score"))]
_AVG = ["average_precision", "average_recall", "average_f1"]
_PICK_COLS = ["ds_clean", "model", "level", "feature_set"]


def chosen(spark, sf):
    return C.average_metrics(C.candidates(results(spark, sf), "ZScore"))


@query("weighted_average_metrics", O.statement(
    _PICKED, f"SELECT {', '.join(_PICK_COLS)}, {', '.join(rs(c) for c in _AVG)} FROM cand"))
def weighted_average_metrics(spark, sf):
    return chosen(spark, sf).select(*_PICK_COLS, *[r(c) for c in _AVG])


@query("select_oracle", O.statement(
    _PICKED, f"SELECT {', '.join(_PICK_COLS)}, {rs('f1_score_anomalous_mean')} FROM best_f1"))
def select_oracle(spark, sf):
    return C.select_best(chosen(spark, sf), "f1_score_anomalous_mean").select(*_PICK_COLS, r("f1_score_anomalous_mean"))


@query("select_unsupervised", O.statement(
    _PICKED, f"SELECT {', '.join(_PICK_COLS)}, {rs('separation_score', 5)} FROM best_sep"))
def select_unsupervised(spark, sf):
    return C.select_best(chosen(spark, sf), "separation_score").select(*_PICK_COLS, r("separation_score", 5))


@query("select_fixed_config", O.statement(
    _PICKED, f"SELECT {', '.join(_PICK_COLS)}, {rs('average_f1')} FROM cand WHERE level = 'L3_Global' AND feature_set = "
             "'delta_cyclical'"))
def select_fixed_config(spark, sf):
    config = _FIXED["6. Fixed Config DT+Cyclical"]
    return C.select_fixed(chosen(spark, sf), config).select(*_PICK_COLS, r("average_f1"))


def _long_sql():
    sources = [(C.ORACLE, "SELECT * FROM best_f1"), (C.UNSUPERVISED, "SELECT * FROM best_sep")]
    sources += [(C.config_text(n, c), f"SELECT * FROM cand WHERE level = '{c[1]}' AND feature_set = '{c[2]}'")
                for n, c in _FIXED.items()]
    rows = [f"('{ds}', '{c}', '{m}', '{C.BASELINE}', {v[i]}::DOUBLE)" for ds, v in _BASE.items()
            for i, (c, m, _) in enumerate(C.METRIC_MAP)]
    parts = [f"SELECT * FROM (VALUES {', '.join(rows)}) AS b(ds_clean, class, metric, approach, score)"]
    for name, q in sources:
        parts += [f"SELECT ds_clean, '{c}', '{m}', '{name}', {col} FROM ({q})" for c, m, col in C.METRIC_MAP]
    return [*_PICKED, ("long", " UNION ALL ".join(parts))]


_LONG = _long_sql()


def long_table(spark, sf):
    return C.comparison_long(C.approaches(chosen(spark, sf), _FIXED), C.baseline_table(spark, _BASE))


@query("comparison_long", O.statement(_LONG, f"SELECT ds_clean, class, metric, approach, {rs('score')} FROM long"))
def comparison_long(spark, sf):
    return long_table(spark, sf).select("ds_clean", "class", "metric", "approach", r("score"))


_NAMES = [C.BASELINE, C.ORACLE, C.UNSUPERVISED, *[C.config_text(n, c) for n, c in _FIXED.items()]]


@query("comparison_wide", O.statement(
    _LONG, "SELECT ds_clean, class, metric, " + ", ".join(
        f"max(CASE WHEN approach = '{n}' THEN printf('%.3f', score) END) AS \"{n}\"" for n in _NAMES)
    + " FROM long GROUP BY ds_clean, class, metric"))
def comparison_wide(spark, sf):
    return C.comparison_wide(long_table(spark, sf), _NAMES).drop("ord")


@query("selection_labels", O.statement(
    [*_PICKED, ("base", "SELECT * FROM (VALUES ('clicks'), ('orders'), ('small_log')) AS b(ds_clean)")],
    "SELECT b.ds_clean, concat_ws(chr(10), b.ds_clean, '[GMM: ' || split_part(u.level, '_', 1) || ' | ' || u.feature_set "
    "|| ']', '[Oracle: ' || split_part(o.level, '_', 1) || ' | ' || o.feature_set || ']') AS label FROM base b "
    "LEFT JOIN best_sep u USING (ds_clean) LEFT JOIN best_f1 o USING (ds_clean)"))
def selection_labels(spark, sf):
    t = chosen(spark, sf)
    return C.selection_labels(C.baseline_table(spark, _BASE), C.select_best(t, "separation_score"),
                              C.select_best(t, "f1_score_anomalous_mean"))


_ORDERS = {"level_ord": ("level", levels.LEVELS), "feature_ord": ("feature_set", _ALL),
           "model_ord": ("model", ["ZScore", "DBSCAN"])}


@query("chart_ready_metrics", O.statement(
    _RESULTS, " UNION ALL ".join(
        f"SELECT dataset, model, level, feature_set, '{m}' AS metric, '{t}' AS title, {O.rnd(m)} AS value, " + ", ".join(
            f"CASE {c} " + " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(vs)) + f" ELSE 0 END AS {n}"
            for n, (c, vs) in _ORDERS.items())
        + " FROM results WHERE level IN ('L3_Global', 'L2_Activity')" for m, t in C.CHART_METRICS.items())))
def chart_ready_metrics(spark, sf):
    t = C.chart_ready(results(spark, sf), levels=levels.LEVELS, models=("ZScore", "DBSCAN"))
    return t.where(F.col("level") != "L1_Micro").withColumn("value", r("value"))


# ---- mixtures -----------------------------------------------------------------------------------------------------

_COMPONENTS = [*_SCORES, ("comp", f"""SELECT {O.SKEY}, quantile_cont(score, 0.25) AS mu0, quantile_cont(score, 0.75) AS mu1,
    min(score) AS lo, max(score) AS hi, avg(score) AS mean FROM scores WHERE split = 'val' AND model <> 'DBSCAN'
    GROUP BY ALL"""),
    ("comps", "SELECT *, ((mu1 - mu0) / 2) * ((mu1 - mu0) / 2) + 1e-6::DOUBLE AS var0, "
              "(mu1 - mu0) * (mu1 - mu0) + 1e-6::DOUBLE AS var1 FROM comp"),
    ("grid", "SELECT *, i, lo + i * ((hi - lo) / 999.0::DOUBLE) AS x FROM comps CROSS JOIN range(1000) AS g(i)"),
    ("lik", "SELECT *, ln(0.7::DOUBLE) - 0.5 * ln(var0) - (x - mu0) * (x - mu0) / (2 * var0) AS l0, "
            "ln(0.3::DOUBLE) - 0.5 * ln(var1) - (x - mu1) * (x - mu1) / (2 * var1) AS l1 FROM grid")]


@query("gmm_limit_grid", O.statement(
    _COMPONENTS, f"SELECT {O.SKEY}, {O.rnd('coalesce(arg_min(x, i) FILTER (l1 >= l0), any_value(mean))')} AS "
                 f"threshold_value, {O.rnd('abs(any_value(mu0) - any_value(mu1)) / (sqrt(any_value(var0)) + sqrt(any_value(var1)))')} "
                 "AS separation_score FROM lik GROUP BY ALL"))
def gmm_limit_grid(spark, sf):
    # Component parameters from quartiles, so that SQL can state them too.
    val = T.validation_scores(z_scores(spark, sf).where(F.col("model") != "DBSCAN"))
    keys = T.score_keys(val)
    q = T.exact_quantiles(val, keys, "score", {"mu0": 0.25, "mu1": 0.75})
    ends = val.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"))
    gap = F.col("mu1") - F.col("mu0")
    comps = q.join(ends, keys).withColumns({
        "var0": (gap / 2) * (gap / 2) + 1e-6, "var1": gap * gap + 1e-6, "w0": F.lit(0.7), "w1": F.lit(0.3),
        "mid": F.lit(None).cast("double")})
    return T.limits_from_components(comps).select(*keys, r("threshold_value"), r("separation_score"))


def _em_sql():
    """Mixtures by a recursive statement: the same start, steps and stop as the operator; table ``limits``."""
    by, eps = f"PARTITION BY {O.SKEY}", "10 * 2.220446049250313e-16::DOUBLE"
    params = ", ".join(T._PARAMS)
    ids = ", ".join(f"e.{c}" for c in O.SKEY.split(", "))

    def renewed(source, more):
        """Parameters from mass m, sum s and squares q of what lies off the centres c of ``source``."""
        new = ", ".join(f"m{i} / (m0 + m1) AS n_w{i}, c{i} + s{i} / m{i} AS n_mu{i}, greatest(q{i} / m{i} - (s{i} / m{i}) * "
                        f"(s{i} / m{i}), 0) + 1e-6::DOUBLE AS n_var{i}" for i in (0, 1))
        return f"SELECT {O.SKEY}, {more}, {new} FROM ({source})"

    def sums(weight):
        return ", ".join(f"sum({weight(i)}) + {eps} AS m{i}, sum({weight(i)} * (x - c{i})) AS s{i}, "
                         f"sum({weight(i)} * (x - c{i}) * (x - c{i})) AS q{i}" for i in (0, 1))

    start = renewed(f"SELECT {O.SKEY}, any_value(c0) AS c0, any_value(c1) AS c1, "
                    + sums(lambda i: f"CASE WHEN x {'<=' if i == 0 else '>'} cut THEN n ELSE 0 END")
                    + f" FROM (SELECT *, tt / nn AS c0, tt / nn AS c1 FROM pts JOIN tot USING ({O.SKEY}) JOIN cuts USING "
                      f"({O.SKEY}) WHERE nn > {T.FEW_SCORES}) GROUP BY {O.SKEY}", "0 AS it")
    logs = ", ".join(f"ln(w{i}) - 0.5::DOUBLE * (ln(2 * {O.PI}::DOUBLE * var{i}) + (x - mu{i}) * (x - mu{i}) / var{i}) AS l{i}"
                     for i in (0, 1))
    rows = (f"SELECT e.*, x, n, mu0 AS c0, mu1 AS c1, {logs} FROM em e JOIN pts p ON NOT done AND "
            + " AND ".join(f"e.{c} = p.{c}" for c in O.SKEY.split(", ")))
    normed = f"SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS z FROM ({rows})"
    stepped = renewed(
        f"SELECT {O.SKEY}, it, any_value(last) AS last, {', '.join(f'any_value({c}) AS {c}' for c in [*T._PARAMS, 'c0', 'c1'])}, "
        f"sum(n * z) / sum(n) AS bound, " + sums(lambda i: f"n * exp(l{i} - z)") + f" FROM ({normed}) GROUP BY {O.SKEY}, it",
        f"it, last, bound, {params}")
    stop = f"(coalesce(abs(bound - last) < {T.TOLERANCE}::DOUBLE, false) OR it = {T.MAX_ITERATIONS})"
    chosen = ", ".join(f"CASE WHEN {stop} THEN {c} ELSE n_{c} END" for c in T._PARAMS)
    em = (f"SELECT {O.SKEY}, it, {', '.join(f'n_{c} AS {c}' for c in T._PARAMS)}, CAST(NULL AS DOUBLE) AS last, false AS done "
          f"FROM ({start}) UNION ALL SELECT {O.SKEY}, it + 1, {chosen}, bound, {stop} FROM ({stepped})")
    ordered = ", ".join(f"CASE WHEN mu0 <= mu1 THEN {c} ELSE {c[:-1] + '10'[int(c[-1])]} END AS {c}" for c in T._PARAMS)
    like = [f"ln(w{i}) - 0.5::DOUBLE * ln(var{i}) - (g - mu{i}) * (g - mu{i}) / (2.0::DOUBLE * var{i})" for i in (0, 1)]
    return [
        *_SCORES,
        ("pts", f"SELECT {O.SKEY}, score AS x, count(*)::DOUBLE AS n FROM scores WHERE split = 'val' AND model <> 'DBSCAN' AND "
                f"score IS NOT NULL GROUP BY {O.SKEY}, score"),
        ("tot", f"SELECT {O.SKEY}, sum(n) AS nn, sum(n * x) AS tt, min(x) AS lo, max(x) AS hi FROM pts GROUP BY {O.SKEY}"),
        ("mids", f"SELECT {O.SKEY}, median(score) AS mid FROM scores WHERE split = 'val' AND model <> 'DBSCAN' GROUP BY {O.SKEY}"),
        ("cuts", f"SELECT {O.SKEY}, x AS cut FROM (SELECT *, sum(n) OVER ({by} ORDER BY x) AS c, sum(n * x) OVER ({by} ORDER BY x) "
                 f"AS t FROM pts JOIN tot USING ({O.SKEY})) WHERE c < nn QUALIFY row_number() OVER ({by} ORDER BY t * t / c + "
                 "(tt - t) * (tt - t) / (nn - c) DESC, x) = 1"),
        ("em", em),
        ("fitted", f"SELECT {O.SKEY}, {ordered} FROM em WHERE done"),
        ("grid", f"SELECT *, lo + i * ((hi - lo) / {T.GRID_POINTS - 1}.0::DOUBLE) AS g FROM fitted JOIN tot USING ({O.SKEY}) CROSS "
                 f"JOIN range({T.GRID_POINTS}) r(i)"),
        ("crossed", f"SELECT {O.SKEY}, min(g) AS g FROM grid WHERE {like[1]} >= {like[0]} GROUP BY {O.SKEY}"),
        ("limits", f"SELECT {O.SKEY}, CASE WHEN f.mu0 IS NULL THEN mid ELSE coalesce(g, tt / nn) END AS threshold_value, "
                   "CASE WHEN f.mu0 IS NULL THEN 0 ELSE abs(mu0 - mu1) / (sqrt(var0) + sqrt(var1)) END AS separation_score FROM "
                   f"tot JOIN mids USING ({O.SKEY}) LEFT JOIN fitted f USING ({O.SKEY}) LEFT JOIN crossed USING ({O.SKEY})")]


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("gmm_thresholds", _recursive(O.statement(_em_sql(), f"SELECT {O.SKEY}, {rs('threshold_value', 5)} FROM limits")))
def gmm_thresholds(spark, sf):
    return T.gmm_limits(z_scores(spark, sf)).select(*O.SKEY.split(", "), r("threshold_value", 5))


@query("gmm_separation", _recursive(O.statement(_em_sql(), f"SELECT {O.SKEY}, {rs('separation_score', 5)} FROM limits")))
def gmm_separation(spark, sf):
    return T.gmm_limits(z_scores(spark, sf)).select(*O.SKEY.split(", "), r("separation_score", 5))
