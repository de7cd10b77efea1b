"""Event-log roles and the canonical layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros


@dataclass(frozen=True)
class EventLogSpec:
    """Binds the four roles of an event log to physical columns.

    ``event_key`` names one column or several; together they must tell all events apart. ``split_mode`` is ``rows``
    or ``cases``.
    """

    case: str
    act: str
    time: str
    res: str | None = None
    event_key: str | tuple[str, ...] = ()
    split_mode: str = "rows"


# Column names of the supported datasets.
DATASETS = {
    "bpi_2012.csv": EventLogSpec("Case ID", "Activity", "Complete Timestamp", "Resource"),
    "bpi_2013.csv": EventLogSpec("Case ID", "Activity", "Complete Timestamp", "Resource"),
    "BPI_Challenge_2012.csv": EventLogSpec("case:concept:name", "concept:name", "time:timestamp", "org:resource"),
    "RequestForPayment.csv": EventLogSpec("case:concept:name", "concept:name", "time:timestamp", "org:role"),
    "small_log.csv": EventLogSpec("Case ID", "Activity", "Complete Timestamp", None, split_mode="cases"),
    "large_log.csv": EventLogSpec("Case ID", "Activity", "Complete Timestamp", None, split_mode="cases"),
}


def _key(spec: EventLogSpec):
    names = (spec.event_key,) if isinstance(spec.event_key, str) else spec.event_key
    if not names:
        raise ValueError("the spec names no event_key; read_event_log adds one for files")
    return F.concat_ws("-", *[F.col(f"`{n}`").cast("string") for n in names])


def to_canonical(df: DataFrame, spec: EventLogSpec) -> DataFrame:
    """Project a raw log onto event_key, case_id, activity, resource, time, time_us.

    A resource role whose column is absent counts as no resource: the column is then all null and the log is marked
    as having none (see ``has_resource``).
    """
    present = spec.res is not None and spec.res in df.columns
    resource = F.col(f"`{spec.res}`").cast("string") if present else F.lit(None).cast("string")
    return df.select(
        _key(spec).alias("event_key"),
        F.col(f"`{spec.case}`").cast("string").alias("case_id"),
        F.col(f"`{spec.act}`").cast("string").alias("activity"),
        resource.alias("resource", metadata={"has_resource": present}),
        F.col(f"`{spec.time}`").cast("timestamp_ntz").alias("time"),
    ).withColumn("time_us", micros("time"))


def has_resource(log: DataFrame) -> bool:
    """Whether the log came with a resource column; the mark travels with the column."""
    return bool(log.schema["resource"].metadata.get("has_resource", True))
