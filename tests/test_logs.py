import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from logsieve.operators import context, features, order, profile, scale, split
from logsieve.sources.readers import has_line_breaks, parse_utc, read_event_log, read_report
from logsieve.sources.sinks import write_report
from logsieve.sources.spec import EventLogSpec, has_resource

MIXED = [("2024-03-10 02:30:00", dt.datetime(2024, 3, 10, 2, 30)),
         ("2024-03-10T02:30:00.250+02:00", dt.datetime(2024, 3, 10, 0, 30, 0, 250000)),
         ("2024-03-10 02:30:00.123456+0000", dt.datetime(2024, 3, 10, 2, 30, 0, 123456)),
         ("2024/03/10 02:30:00.5", dt.datetime(2024, 3, 10, 2, 30, 0, 500000)),
         ("10/03/2024 02:30", dt.datetime(2024, 10, 3, 2, 30)),
         ("2024-03-10", dt.datetime(2024, 3, 10)),
         ("2024-03-10T02:30:00Z", dt.datetime(2024, 3, 10, 2, 30)),
         ("nonsense", None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_mixed_timestamps_are_utc_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t, _ in MIXED], "t string")
        got = {r["t"]: r["p"] for r in df.select("t", parse_utc("t", "null").alias("p")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == dict(MIXED)


def csv(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


SPEC = EventLogSpec("Case ID", "Activity", "Complete Timestamp", "Resource")
HEAD = "Case ID,Activity,Complete Timestamp,Resource"


def test_csv_log(spark, tmp_path):
    path = csv(tmp_path, "a.csv", [HEAD, "1,A,2024-01-01 10:00:00,x", "1,B,01/01/2024 11:00,", "2,A,bad,y",
                                   "1,A,2024-01-01 10:00:00,x"])
    unreadable = Observation()
    log = read_event_log(spark, path, SPEC, bad="drop", unreadable=unreadable)
    rows = log.collect()
    assert unreadable.get["rows"] == 1
    assert len(rows) == 3 and len({r["event_key"] for r in rows}) == 3
    assert {r["resource"] for r in rows} == {"x", None} and has_resource(log)
    with pytest.raises(Exception, match="unreadable timestamp"):
        read_event_log(spark, path, SPEC).collect()
    assert read_event_log(spark, str(tmp_path / "none.csv"), SPEC) is None


AWKWARD = """Case ID,Activity,Complete Timestamp,Resource
1,"He said ""go"", now",2024-01-01 10:00:00,x
1,"two
lines",01/01/2024 3:04 PM,NA
2,"",2-Jan-2024 10:00,"N/A"
2, padded ,"Jan 2, 2024 11:00",null
3,"a,b",2024-01-03 00:00:00+02:00,""
3,semi;colon,2024-01-04,NULLS
"""


def test_csv_equals_pandas(spark, tmp_path):
    import pandas as pd

    path = str(tmp_path / "awkward.csv")
    with open(path, "w") as f:
        f.write(AWKWARD)
    want = pd.read_csv(path, dtype=str)
    want["t"] = pd.to_datetime(want["Complete Timestamp"], utc=True, format="mixed").dt.tz_localize(None)
    want = [tuple(None if pd.isna(v) else v for v in r) for r in want[["Case ID", "Activity", "Resource", "t"]].itertuples(index=False)]
    assert has_line_breaks(spark, path) and len(want) == 6
    for breaks in (None, True):
        log = read_event_log(spark, path, SPEC, line_breaks=breaks)
        got = log.select("case_id", "activity", "resource", "time").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((c, a, r, t.to_pydatetime()) for c, a, r, t in want), key=repr)
    with open(path, "w") as f:
        f.write(AWKWARD.replace("two\nlines", "one line"))
    assert not has_line_breaks(spark, path) and read_event_log(spark, path, SPEC).count() == 6


def test_reports_keep_awkward_texts(spark, tmp_path):
    rows = [("a \"quoted\", text", 1.5), ("two\nlines", 2.0), ("back\\slash", None)]
    write_report(spark.createDataFrame(rows, "label string, value double"), str(tmp_path / "r"))
    got = read_report(spark, str(tmp_path / "r"), "label string, value double").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_mixed_times(spark):
    cases = {"03/04/2024 10:00": "2024-03-04 10:00:00", "03-04-2024 10:00:00": "2024-03-04 10:00:00",
             "13.04.2024 10:00": "2024-04-13 10:00:00", "04/13/2024 10:00": "2024-04-13 10:00:00",
             "2024-01-02 10:00:00 UTC": "2024-01-02 10:00:00", "2024-01-02T10:00Z": "2024-01-02 10:00:00",
             "2024-01-02 10:00:00+00": "2024-01-02 10:00:00", "2024-01-02 10:00:00.5-0130": "2024-01-02 11:30:00.500000",
             "2024/01/02 10:00": "2024-01-02 10:00:00", "20240102": "2024-01-02 00:00:00",
             "2024-01-02 10:00:00.123456789": "2024-01-02 10:00:00.123456",
             "01/02/2024 3:04 PM": "2024-01-02 15:04:00", "01/02/2024 12:04:05.5 am": "2024-01-02 00:04:05.500000",
             "2-Jan-2024 10:00": "2024-01-02 10:00:00", "Jan 2, 2024 10:00": "2024-01-02 10:00:00",
             "02 December 2024": "2024-12-02 00:00:00", "SEP 30 2024 12:00 P.M.": "2024-09-30 12:00:00",
             "2024-01-02 11:00 PM +0200": "2024-01-02 21:00:00", "01/02/2024 13:04 PM": None, "2-Jam-2024 10:00": None,
             "Feb 30, 2024": None, "2024-02-30": None, "soon": None, None: None}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = frame.select("t", parse_utc("t", "null").alias("p")).collect()
    assert {r.t: r.p and str(r.p) for r in got} == cases


def test_configured_but_absent_resource_counts_as_none(spark, tmp_path):
    path = csv(tmp_path, "b.csv", ["Case ID,Activity,Complete Timestamp", "1,A,2024-01-01 10:00:00"])
    log = read_event_log(spark, path, SPEC)
    assert not has_resource(log) and not has_resource(order.order_events(log))


def busy_log(make_log):
    rows = [("big", "ab"[i % 2] if i % 5 else "c", f"r{i % 3}", float((i * 37) % 400)) for i in range(400)]
    return make_log(rows + [(f"c{i // 4}", "abc"[i % 3], "r1", i * 50.0) for i in range(80)])


def same(a, b, by="event_key"):
    a, b = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b[a.columns].columns)
    for c in a.columns:
        if a[c].dtype == float:
            assert (abs(a[c] - b[c]) < 1e-9).all(), c
        else:
            assert a[c].equals(b[c]), c


def test_long_cases_are_ordered_in_segments(make_log):
    log = busy_log(make_log)
    same(order.order_events(log), order.order_events(log, limit=50))


def test_stretches_give_the_features_of_whole_cases(make_log):
    log = split.split_by_rows(busy_log(make_log))
    plain = features.base_features(order.order_events(log))
    cut = order.order_events(log, limit=50)
    assert order.has_long_cases(cut)
    same(plain, features.base_features(cut, stretch=16))
    same(profile.with_delta(order.order_events(log)), profile.with_delta(cut))


def test_profile_is_the_same_for_long_cases(make_log):
    log = busy_log(make_log)
    a = profile.profile(log).toPandas().sort_values("level").reset_index(drop=True)
    b = profile.profile(order.order_events(log, limit=50)).toPandas().sort_values("level").reset_index(drop=True)
    assert (abs(a.select_dtypes("number") - b.select_dtypes("number")) < 1e-6).all().all()


def test_profile_without_resource_has_no_micro_level(make_log):
    log = make_log([("1", "A", None, i) for i in range(40)], resource=False)
    got = {r["level"]: r for r in profile.rounded_profile(profile.profile(log)).collect()}
    assert set(got) == {"L3_Global", "L2_Activity"}
    assert got["L2_Activity"]["num_models"] == 1 and got["L2_Activity"]["distinct_resources"] == 0


def test_profile_drops_null_groups_but_counts_their_events(make_log):
    log = make_log([("1", "A", "x" if i % 4 else None, i) for i in range(44)])
    got = {r["level"]: r for r in profile.profile(log).collect()}
    assert got["L1_Micro"]["num_models"] == 1 and got["L1_Micro"]["total_events"] == 44
    assert got["L1_Micro"]["avg_events_per_model"] == 33


def test_splits(make_log):
    log = make_log([(f"c{i % 7}", "A", "x", i * 10.0) for i in range(50)])
    count = {r["split"]: r["count"] for r in split.split_by_rows(log).groupBy("split").count().collect()}
    assert count == {"train": 30, "val": 10, "test": 10}
    cases = split.split_by_cases(log).groupBy("case_id").agg(F.countDistinct("split").alias("n"),
                                                            F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in cases)
    assert {r["case_id"]: r["s"] for r in cases} == {
        "c0": "train", "c1": "train", "c2": "train", "c3": "train", "c4": "val", "c5": "test", "c6": "test"}


def test_chronological_position(make_log):
    log = make_log([("c", "A", "x", float((i * 7919) % 20000)) for i in range(300)])
    want = [r["event_key"] for r in log.orderBy("time_us", "event_key").collect()]
    for limit in (2_000_000, 20):
        got = split.chronological_position(log, limit).orderBy("position").collect()
        assert [r["event_key"] for r in got] == want and [r["position"] for r in got] == list(range(300))


def test_workload_of_tied_times(make_log):
    hours = [0, 1, 2, 2, 3.5]
    log = make_log([("c", "A", "x", h * 3600.0) for h in hours])
    got = context.resource_workload(log).orderBy("event_key").collect()
    assert [r["resource_workload"] for r in got] == [1, 2, 2, 3, 3]


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_workload_does_not_depend_on_segments(make_log, limit):
    """A resource whose events all lie within minutes, one spread over days, a missing one, and many equal times."""
    rows = [("c", "A", "busy", float((i * 37) % 400)) for i in range(500)]
    rows += [("d", "B", "calm", float((i * 7919) % 200_000)) for i in range(300)] + [("e", "A", None, 7200.0 * (i // 9)) for i in range(90)]
    log = make_log(rows)
    seen, want = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["time_us"], r["event_key"])):
        earlier = seen.setdefault(r["resource"], [])
        earlier.append(r["time_us"])
        want[r["event_key"]] = sum(t > r["time_us"] - 7_200_000_000 for t in earlier)
    got = context.resource_workload(log, limit=limit)
    assert got.columns == [*log.columns, "resource_workload"]
    assert {r["event_key"]: r["resource_workload"] for r in got.collect()} == want


def test_busy_hour_is_split_over_tasks(make_log):
    log = make_log([("c", "A", "busy", float((i * 37) % 400)) for i in range(1_000)])
    light, hot = scale.part_heavy(context.workload_steps(log), ["resource"], ["_at", "_arrives", "event_key"], 50)
    sizes = [r["count"] for r in hot.groupBy("_seg").count().collect()]
    assert light.count() == 0 and sum(sizes) == 2_000 and len(sizes) > 20 and max(sizes) <= 200
