"""Event logs bound to the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spec import EventLogSpec, to_canonical

K = "cast(regexp_extract(props, '[0-9]+', 0) AS bigint)"

SPECS = {
    "clicks": ("events", {"res": f"concat('R', {K} % 4)"},
               EventLogSpec("user_id", "event_type", "ts", "res", "event_id")),
    "clicks_fine": ("events", {"res": f"cast({K} AS string)"},
                    EventLogSpec("user_id", "event_type", "ts", "res", "event_id")),
    "clicks_gaps": ("events", {"res": f"CASE WHEN {K} < 95 THEN concat('R', {K} % 4) END"},
                    EventLogSpec("user_id", "event_type", "ts", "res", "event_id")),
    "lines": ("lineitem", {"act": "concat(l_returnflag, l_linestatus)"},
              EventLogSpec("l_orderkey", "act", "l_shipdate", "l_suppkey",
                           ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "day"))),
    "orders": ("orders", {}, EventLogSpec("o_custkey", "o_orderpriority", "o_orderdate", None, "o_orderkey",
                                          split_mode="cases")),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The canonical log of a fixture."""
    table, extra, spec = SPECS[name]
    raw = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    raw = raw.withColumns({c: F.expr(e) for c, e in extra.items()})
    if "day" in spec.event_key:
        raw = raw.withColumn("day", F.date_format(spec.time, "yyyyMMdd"))
    return to_canonical(raw, spec)


# The same logs in SQL, written independently.
_K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"
_CLICKS = ("SELECT CAST(event_id AS VARCHAR) AS event_key, CAST(user_id AS VARCHAR) AS case_id, "
           "event_type AS activity, {res} AS resource, ts AS time, epoch_us(ts) AS time_us FROM events")
SQL = {
    "clicks": _CLICKS.format(res=f"'R' || CAST({_K} % 4 AS VARCHAR)"),
    "clicks_fine": _CLICKS.format(res=f"CAST({_K} AS VARCHAR)"),
    "clicks_gaps": _CLICKS.format(res=f"CASE WHEN {_K} < 95 THEN 'R' || CAST({_K} % 4 AS VARCHAR) END"),
    "lines": "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) "
             "AS event_key, CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity, "
             "CAST(l_suppkey AS VARCHAR) AS resource, l_shipdate AS time, epoch_us(l_shipdate) AS time_us "
             "FROM lineitem",
    "orders": "SELECT CAST(o_orderkey AS VARCHAR) AS event_key, CAST(o_custkey AS VARCHAR) AS case_id, "
              "o_orderpriority AS activity, CAST(NULL AS VARCHAR) AS resource, o_orderdate AS time, "
              "epoch_us(o_orderdate) AS time_us FROM orders",
}
