"""SQL statements that state each query's result independently of the Spark code."""

from __future__ import annotations

from .fixtures import SQL
from ..operators.context import GRAINS, RESOURCE_GRAINS
from ..operators.levels import FEATURE_SETS, features_of

PI = "3.141592653589793"


def rnd(x: str, n: int = 6) -> str:
    # Adding zero turns -0.0 into 0.0.
    return f"(round({x}, {n}) + 0.0::DOUBLE)"


def squash(x: str, n: int = 6) -> str:
    """Sign and logarithm: comparable digits for values of any size."""
    return rnd(f"sign({x}) * ln(1 + abs({x}))", n)


def h32(purpose: str, run: str = "run", key: str = "event_key") -> str:
    return f"('0x' || substr(md5('7|' || CAST({run} AS VARCHAR) || '|{purpose}|' || {key}), 1, 8))::BIGINT"


def uni(purpose: str) -> str:
    return f"({h32(purpose)} / 4294967296.0::DOUBLE)"


def statement(parts: list[tuple[str, str]], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + f"\n{select}"


def ordered(fix: str):
    return [("log", SQL[fix]),
            ("ordered", "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY time_us, event_key) AS event_seq, "
                        "count(activity) OVER (PARTITION BY case_id) AS trace_len, "
                        "min(time_us) OVER (PARTITION BY case_id) AS case_start_us FROM log")]


def split(fix: str, mode: str = "rows"):
    label = "CASE WHEN p < floor(n * 0.6) THEN 'train' WHEN p < floor(n * 0.8) THEN 'val' ELSE 'test' END"
    if mode == "rows":
        cut = (f"SELECT * EXCLUDE (p, n), {label} AS split FROM (SELECT *, row_number() OVER (ORDER BY time_us, "
               "event_key) - 1 AS p, count(*) OVER () AS n FROM ordered)")
        return [*ordered(fix), ("cut", cut)]
    cases = (f"SELECT case_id, {label} AS split FROM (SELECT case_id, row_number() OVER (ORDER BY min(time_us), case_id)"
             " - 1 AS p, count(*) OVER () AS n FROM log GROUP BY case_id)")
    return [*ordered(fix), ("cases", cases), ("cut", "SELECT * FROM ordered JOIN cases USING (case_id)")]


def poisoned(fix: str, runs, mode: str = "rows"):
    runs = ", ".join(f"({r})" for r in runs)
    return [
        *split(fix, mode),
        ("labels", "SELECT activity, row_number() OVER (ORDER BY activity) AS i FROM "
                   "(SELECT DISTINCT activity FROM log)"),
        ("gaps", "SELECT *, coalesce(time_us - lag(time_us) OVER (PARTITION BY case_id ORDER BY event_seq), 0) AS gap "
                 "FROM cut"),
        ("gapstats", "SELECT activity, s1::DOUBLE / n AS m, CASE WHEN n > 1 THEN sqrt((n * s2 - s1 * s1)::DOUBLE / (n * (n - 1.0::DOUBLE))) "
                     "ELSE 0 END AS s FROM (SELECT activity, count(*) AS n, sum(gap::HUGEINT) AS s1, sum(gap::HUGEINT * "
                     "gap::HUGEINT) AS s2 FROM gaps WHERE gap > 0 GROUP BY activity)"),
        ("perrun", f"SELECT *, (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM log) AS n, "
                   f"(SELECT count(*) FROM labels) AS k FROM gaps CROSS JOIN (VALUES {runs}) AS r(run)"),
        ("marked", f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY run ORDER BY {h32('activity')}, event_key) <= n "
                   f"THEN 1 ELSE 0 END AS activity_label, CASE WHEN event_seq > 1 AND row_number() OVER (PARTITION BY "
                   f"run, event_seq > 1 ORDER BY {h32('time')}, event_key) <= n THEN 1 ELSE 0 END AS time_label "
                   "FROM perrun"),
        ("picked", f"SELECT m.*, l.i, CAST(floor({uni('label')} * (k - 1)) AS BIGINT) AS step FROM marked m "
                   "JOIN labels l ON m.activity = l.activity"),
        ("swapped", "SELECT p.* EXCLUDE (activity), CASE WHEN activity_label = 1 THEN l.activity ELSE p.activity END "
                    "AS activity FROM picked p LEFT JOIN labels l "
                    "ON l.i = CASE WHEN step + 1 >= p.i THEN step + 2 ELSE step + 1 END"),
        ("delayed", f"SELECT w.*, CASE WHEN time_label = 1 THEN CAST(floor(greatest(0.0, (coalesce(m, 0) + coalesce(s, 0))"
                    f" * (1.0 + {uni('reach')}) - gap) + 0.5) AS BIGINT) ELSE 0 END AS "
                    "shift_us FROM swapped w LEFT JOIN gapstats g ON w.activity = g.activity"),
        ("poisoned", "SELECT event_key, case_id, activity, resource, time + to_microseconds(shift_us) AS time, "
                     "time_us + shift_us AS time_us, event_seq, trace_len, case_start_us, split, run, activity_label, "
                     "time_label, time_label AS is_true_anomaly, shift_us FROM delayed"),
    ]


def features(base: list, source: str):
    """Base features of ``source`` (ordered, cut or poisoned)."""
    run = "run, " if source == "poisoned" else ""
    w = f"PARTITION BY {run}case_id ORDER BY event_seq"
    hour = "(hour(time) + minute(time) / 60.0::DOUBLE)"
    day = "(isodow(time) - 1)"
    return [
        *base,
        ("gapped", f"SELECT * REPLACE (coalesce(activity, '0') AS activity), coalesce(lag(coalesce(activity, '0')) "
                   f"OVER ({w}), 'START') AS prev_act, coalesce(time_us - lag(time_us) OVER ({w}), 0) / 1e6::DOUBLE "
                   f"AS delta_t FROM {source}"),
        ("feats", f"""SELECT *, delta_t / (rolling_delta_t_mean + 1e-6::DOUBLE) AS momentum_ratio FROM (
            SELECT *, (time_us - case_start_us) / 1e6::DOUBLE AS cum_t, event_seq AS event_idx,
            event_seq / trace_len::DOUBLE AS trace_pos,
            row_number() OVER (PARTITION BY {run}case_id, activity ORDER BY event_seq) - 1 AS act_rework_count,
            coalesce(avg(delta_t) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS rolling_delta_t_mean,
            {day} AS weekday,
            sin(2 * {PI}::DOUBLE * {hour} / 24) AS hour_sin, cos(2 * {PI}::DOUBLE * {hour} / 24) AS hour_cos,
            sin(2 * {PI}::DOUBLE * {day} / 7) AS day_sin, cos(2 * {PI}::DOUBLE * {day} / 7) AS day_cos,
            {hour} / 24 AS hour_linear, {day} / 6.0::DOUBLE AS day_linear,
            event_seq / ((time_us - case_start_us) / 1e6::DOUBLE + 1.0) AS event_density FROM gapped)"""),
    ]


WORKLOAD = ("row_number() OVER (PARTITION BY {r}resource ORDER BY time_us, event_key) - count(*) OVER (PARTITION BY "
            "{r}resource ORDER BY time_us RANGE BETWEEN UNBOUNDED PRECEDING AND 7200000000 PRECEDING)")


def context(base: list, run: bool, resource: bool = True, grains=None):
    """Base features plus workload, expected_* and z_score_* as table ctx."""
    r, rj = ("run, ", "f.run = {s}.run AND ") if run else ("", "")
    load = WORKLOAD.format(r=r) if resource else "0"
    parts = [*base, ("filled", "SELECT * REPLACE (coalesce(resource, '0') AS resource) FROM feats"),
             ("loaded", f"SELECT *, CAST({load} AS DOUBLE) AS resource_workload FROM filled")]
    cols, joins = [], []
    for g in (GRAINS if grains is None else grains):
        keys, value, expected, z = GRAINS[g]
        if g in RESOURCE_GRAINS and not resource:
            cols += [f"0.0::DOUBLE AS expected_{expected}", f"0.0::DOUBLE AS z_score_{z}"]
            continue
        parts.append((f"s_{g}", f"SELECT {r}{', '.join(keys)}, avg({value}) AS m, "
                                f"coalesce(stddev_samp({value}), 0) AS s FROM filled WHERE split = 'train' "
                                f"GROUP BY {r}{', '.join(keys)}"))
        on = rj.format(s=f"s_{g}") + " AND ".join(f"f.{k} = s_{g}.{k}" for k in keys)
        joins.append(f"LEFT JOIN s_{g} ON {on}")
        cols += [f"coalesce(s_{g}.m, 0) AS expected_{expected}",
                 f"(f.{value} - coalesce(s_{g}.m, 0)) / (coalesce(s_{g}.s, 0) + 1e-6::DOUBLE) AS z_score_{z}"]
    parts.append(("ctx", f"SELECT f.*, {', '.join(cols)} FROM loaded f {' '.join(joins)}"))
    return parts


def levels(base: list, source: str = "ctx", which=("L3_Global", "L2_Activity", "L1_Micro")):
    groups = {"L3_Global": ("''", "''"), "L2_Activity": ("coalesce(activity, '0')", "''"),
              "L1_Micro": ("coalesce(activity, '0')", "coalesce(resource, '0')")}
    rows = " UNION ALL ".join(f"SELECT *, '{lv}' AS level, {groups[lv][0]} AS g_act, {groups[lv][1]} AS g_res "
                              f"FROM {source}" for lv in which)
    return [*base, ("grouped", rows)]


def scaled(base: list, sets: list[str], minimum: int = 30):
    """Scaled float32 features of usable groups."""
    names = features_of({s: FEATURE_SETS[s] for s in sets})
    aggs = ", ".join(f"min({c}::FLOAT) FILTER (split = 'train') AS lo_{c}, max({c}::FLOAT) FILTER (split = 'train') - "
                     f"min({c}::FLOAT) FILTER (split = 'train') AS ptp_{c}" for c in names)
    outs = ", ".join(f"(({c}::FLOAT::DOUBLE - lo_{c}::DOUBLE) / (ptp_{c}::DOUBLE + 1e-8::DOUBLE))::FLOAT AS {c}"
                     for c in names)
    return [*base,
            ("ranges", f"SELECT level, g_act, g_res, count(*) FILTER (split = 'train') AS n_train, {aggs} FROM grouped "
                       "GROUP BY level, g_act, g_res"),
            ("usable", f"SELECT * FROM ranges WHERE n_train >= {minimum} OR (level = 'L3_Global' AND n_train > 0)"),
            ("scaled", f"SELECT event_key, split, g.level, g.g_act, g.g_res, {outs} FROM grouped g JOIN usable u ON "
                       "g.level = u.level AND g.g_act = u.g_act AND g.g_res = u.g_res")]


def points(base: list, sets: list[str]):
    """Distinct vectors per group as x0, x1, … (0 where the set is shorter)."""
    dims = max(len(FEATURE_SETS[s]) for s in sets)
    vec = " UNION ALL ".join(
        f"SELECT event_key, split, level, g_act, g_res, '{s}' AS feature_set, " + ", ".join(
            f"{FEATURE_SETS[s][i] if i < len(FEATURE_SETS[s]) else '0::FLOAT'} AS x{i}" for i in range(dims))
        + " FROM scaled" for s in sets)
    x = ", ".join(f"x{i}" for i in range(dims))
    dist = " + ".join(f"(a.x{i}::DOUBLE - b.x{i}::DOUBLE) * (a.x{i}::DOUBLE - b.x{i}::DOUBLE)" for i in range(dims))
    key = "level, g_act, g_res, feature_set"
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    return [*base, ("vectors", vec),
            ("points", f"SELECT {key}, {x}, min(event_key) AS pid, count(*) AS w, count(*) FILTER (split = 'train') AS "
                       f"w_train FROM vectors GROUP BY {key}, {x}")], key, x, dist, same


def neighbours(base: list, sets: list[str], k: int):
    """lists: for each point its nearest points up to weight k among all events; kd: the k-th distance."""
    parts, key, x, dist, same = points(base, sets)
    return [*parts,
            ("pairs", f"SELECT {', '.join('a.' + c for c in key.split(', '))}, a.pid AS qid, b.pid, b.w, "
                      f"sqrt({dist}) AS d FROM points a JOIN points b ON {same}"),
            ("lists", f"SELECT *, coalesce(sum(w) OVER (PARTITION BY {key}, qid ORDER BY d, pid ROWS BETWEEN UNBOUNDED "
                      f"PRECEDING AND 1 PRECEDING), 0) AS before FROM pairs QUALIFY before < {k}"),
            ("kd", f"SELECT {key}, qid AS pid, CASE WHEN sum(w) >= {k} THEN max(d) END AS kd FROM lists "
                   f"GROUP BY {key}, qid")], key, x


def knee(base: list, sets: list[str], k: int = 5):
    parts, key, x = neighbours(base, sets, k)
    curve = (f"SELECT {key}, d, row_number() OVER (PARTITION BY {key} ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY "
             f"{key}) AS n, min(d) OVER (PARTITION BY {key}) AS d0, max(d) OVER (PARTITION BY {key}) AS d1 FROM "
             f"(SELECT {key}, kd AS d, unnest(range(w)) FROM kd JOIN points USING ({key}, pid))")
    top = (f"SELECT {key}, CASE WHEN n < {k + 1} THEN 0.5 ELSE greatest(0.01, d) END AS eps FROM curve QUALIFY "
           f"row_number() OVER (PARTITION BY {key} ORDER BY abs(i * (d1 - d0) - (d - d0) * (n - 1)) DESC, i) = 1")
    return [*parts, ("curve", curve), ("knee", top)], key, x


# Stand-in scorers for the evaluation queries: z-scores, and a flag that takes the place of the noise flag.
SCORERS = {("ZScore", "act"): "z_score_act", ("ZScore", "transition"): "z_score_transition",
           ("ZScore", "cum_t"): "z_score_cum_t", ("DBSCAN", "act"): "flag"}


def z_scores(fix: str, runs, mode: str = "rows", resource: bool = True, tag: str = ""):
    """Long score table ``scores`` of the stand-in scorers at all levels."""
    grains = ["activity", "transition", "cum_t"]
    parts = context(features(poisoned(fix, runs, mode), "poisoned"), True, resource, grains)
    parts = levels(parts, which=("L3_Global", "L2_Activity", "L1_Micro") if resource else ("L3_Global", "L2_Activity"))
    rows = " UNION ALL ".join(
        f"SELECT run, level, g_act, g_res, event_key, split, is_true_anomaly, '{m}' AS model, '{fs}' AS feature_set, "
        + (f"round(ln(1 + abs({c})), 6)" if m != "DBSCAN" else "CASE WHEN abs(z_score_act) > 2 THEN 1.0::DOUBLE ELSE "
           "0.0::DOUBLE END") + " AS score FROM grouped" for (m, fs), c in SCORERS.items())
    return [(n + tag if n == "scores" else n, q) for n, q in [*parts, ("scores", rows)]]


SKEY = "run, level, g_act, g_res, model, feature_set"
CKEY = "run, model, level, feature_set"


def judged(base: list, multipliers):
    """limits, predicted, cells (per group), cm and metric (per configuration)."""
    ks = ", ".join(f"({float(m)}::DOUBLE)" for m in multipliers)
    f1 = "CASE WHEN p_{c} + r_{c} > 0 THEN 2 * p_{c} * r_{c} / (p_{c} + r_{c}) ELSE 0 END"
    return [
        *base,
        ("quart", f"SELECT {SKEY}, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM scores WHERE "
                  f"split = 'val' AND model <> 'DBSCAN' GROUP BY {SKEY}"),
        ("limits", f"SELECT {SKEY}, multiplier, q3 + multiplier * (q3 - q1) AS threshold_value FROM quart CROSS JOIN "
                   f"(VALUES {ks}) AS k(multiplier)"),
        ("rows_k", f"SELECT * FROM scores CROSS JOIN (VALUES {ks}) AS k(multiplier)"),
        ("predicted", f"SELECT s.*, l.threshold_value, CASE WHEN s.model = 'DBSCAN' THEN CASE WHEN score = 1.0 THEN 1 "
                      "ELSE 0 END WHEN score > coalesce(threshold_value, 0) THEN 1 ELSE 0 END AS predicted FROM rows_k s "
                      f"LEFT JOIN limits l USING ({SKEY}, multiplier)"),
        ("cells", f"SELECT {SKEY}, multiplier, any_value(threshold_value) AS threshold_value, "
                  "count(*) FILTER (split = 'test' AND is_true_anomaly = 1 AND predicted = 1) AS tp, "
                  "count(*) FILTER (split = 'test' AND is_true_anomaly = 0 AND predicted = 1) AS fp, "
                  "count(*) FILTER (split = 'test' AND is_true_anomaly = 1 AND predicted = 0) AS fn, "
                  "count(*) FILTER (split = 'test' AND is_true_anomaly = 0 AND predicted = 0) AS tn "
                  f"FROM predicted GROUP BY {SKEY}, multiplier HAVING count(*) FILTER (split = 'val') > 0 AND "
                  "count(*) FILTER (split = 'test') > 0"),
        ("cm", f"SELECT {CKEY}, multiplier, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, "
               "CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, "
               "CASE WHEN model <> 'DBSCAN' THEN avg(coalesce(threshold_value, 0)) END AS threshold_value, "
               "avg(CASE WHEN model = 'DBSCAN' THEN 0 ELSE coalesce(2 * threshold_value, 0) END) AS "
               f"separation_score FROM cells GROUP BY {CKEY}, multiplier"),
        ("rates", "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p_a, "
                  "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r_a, "
                  "CASE WHEN tn + fn > 0 THEN tn / (tn + fn)::DOUBLE ELSE 0 END AS p_n, "
                  "CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS r_n FROM cm"),
        ("metric", f"SELECT {CKEY}, multiplier, threshold_value, separation_score, tp, fp, fn, tn, "
                   "CASE WHEN tp + fp + fn + tn > 0 THEN (tp + fp) / (tp + fp + fn + tn)::DOUBLE * 100 ELSE 0 END AS "
                   "predicted_anomaly_rate, p_a AS precision_anomalous, r_a AS recall_anomalous, "
                   f"{f1.format(c='a')} AS f1_score_anomalous, p_n AS precision_normal, r_n AS recall_normal, "
                   f"{f1.format(c='n')} AS f1_score_normal FROM rates"),
    ]


METRIC_NAMES = ["predicted_anomaly_rate", "precision_anomalous", "recall_anomalous", "f1_score_anomalous",
                "precision_normal", "recall_normal", "f1_score_normal"]


def averaged(base: list, dataset: str):
    cols = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in METRIC_NAMES)
    return [*base, ("table_r", f"SELECT '{dataset}' AS dataset, model, level, feature_set, avg(threshold_value) AS "
                               f"threshold_value_mean, avg(separation_score) AS separation_score, {cols} FROM metric "
                               "GROUP BY model, level, feature_set")]
