"""Reading event logs and stored tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .spec import EventLogSpec, to_canonical

# Date (year first, compact, month and day before the year, or with the month's name), time, up to nine digits of
# fraction, half of the day, zone.
_MONTH = ("((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?"
          "|nov(?:ember)?|dec(?:ember)?))")
_DATE = (r"(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})|(\d{4})(\d{2})(\d{2})|(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
         rf"|(\d{{1,2}})[-/. ]\s*{_MONTH}[-/., ]\s*(\d{{4}})|{_MONTH}\.?[-/ ]\s*(\d{{1,2}})(?:,|[-/ ])\s*(\d{{4}}))")
_TIME = (r"(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*((?i:[ap])\.?(?i:m)\.?)?"
         r"\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?")
STAMP = f"^{_DATE}{_TIME}$"
# What stands for a missing value in a file, besides nothing at all.
MISSING = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
           "NaN", "None", "n/a", "nan", "null"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def parse_utc(text: str | Column, bad: str = "fail") -> Column:
    """Parse timestamps of mixed formats to zone-less UTC.

    A value that fits no format stops the job with ``bad='fail'`` and becomes null with ``bad='null'``. The result
    does not depend on the session time zone. Dates with the year last are read month first, and day first only where
    the first number exceeds 12; months may be English names, full or cut to three letters; hours may be of a half day
    (1 to 12 with AM or PM); a time without zone is UTC.
    """
    value = F.trim(F.col(text) if isinstance(text, str) else text)

    def part(i):
        return F.nullif(F.regexp_extract(value, STAMP, i), F.lit(""))

    def number(*groups):
        return F.coalesce(*[part(i) for i in groups]).cast("int")

    # With the year last the month comes first, unless that number can only be a day.
    swap = number(7) > 12
    name = F.lower(F.substring(F.coalesce(part(11), part(13)), 1, 3))
    named = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int")
    month = F.coalesce(number(2, 5), F.when(swap, number(8)).otherwise(number(7)), named)
    day = F.coalesce(number(3, 6), F.when(swap, number(7)).otherwise(number(8)), number(10, 14))
    half = F.lower(F.substring(part(20), 1, 1))
    hour = F.when(half.isNull(), F.coalesce(number(16), F.lit(0))).when(
        number(16).between(1, 12), number(16) % 12 + F.when(half == "p", 12).otherwise(0))
    whole = F.try_make_timestamp_ntz(number(1, 4, 9, 12, 15), month, day, hour, F.coalesce(number(17), F.lit(0)),
                                     F.coalesce(number(18), F.lit(0)).cast("decimal(16,6)"))
    # Digits beyond the microsecond are cut.
    micros = F.substring(F.rpad(F.coalesce(part(19), F.lit("")), 9, "0"), 1, 6).cast("bigint")
    zone = F.when(part(21).rlike("^[+-]"), F.regexp_replace(part(21), ":", ""))
    offset = F.coalesce((F.substring(zone, 2, 2).cast("int") * 60 + F.coalesce(
        F.nullif(F.substring(zone, 4, 2), F.lit("")).cast("int"), F.lit(0)))
        * F.when(zone.startswith("-"), -1).otherwise(1), F.lit(0)).cast("bigint")
    parsed = F.timestamp_add("MICROSECOND", micros - offset * 60_000_000, whole)
    if bad == "null":
        return parsed
    message = F.concat(F.lit("unreadable timestamp: "), F.coalesce(value, F.lit("null")))
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("timestamp_ntz"))


def _quoted(reader):
    """Fields may be quoted; a quote within is doubled."""
    return reader.option("header", True).option("quote", '"').option("escape", '"')


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may hold a line break: some line has an odd number of quotes."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


def read_csv_text(spark: SparkSession, path: str, line_breaks: bool | None = None) -> DataFrame:
    """A CSV file with header, all columns as text; empty fields and the markers in ``MISSING`` are null, quoted or not.

    With line breaks inside quotes a file cannot be cut into splits and is read in one task. ``line_breaks`` says whether
    there are any; by default one scan of the lines, in splits, finds out, so that files without stay divisible.
    """
    if line_breaks is None:
        line_breaks = has_line_breaks(spark, path)
    raw = _quoted(spark.read).option("inferSchema", False).option("multiLine", line_breaks).csv(path)
    there = [F.col(f"`{c}`") for c in raw.columns]
    return raw.select(*[F.when(~c.isin("", *MISSING), c).alias(n) for c, n in zip(there, raw.columns, strict=True)])


def read_event_log(spark: SparkSession, path: str, spec: EventLogSpec, bad: str = "fail",
                   unreadable: Observation | None = None, line_breaks: bool | None = None) -> DataFrame | None:
    """Read a CSV event log with header into the canonical layout; None when the file is missing.

    All columns are read as text (``read_csv_text``), so no inference pass runs. ``bad`` is ``fail`` or ``drop``; rows dropped
    are counted in the observation ``unreadable`` as ``rows``. Files have no event key: the content of the row, with a running number among rows of equal content, takes its place.
    """
    if not path_exists(spark, path):
        return None
    raw = read_csv_text(spark, path, line_breaks)
    names = list(raw.columns)
    time = parse_utc(F.col(f"`{spec.time}`"), "null" if bad == "drop" else "fail")
    content = F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
    rows = raw.withColumn("_content", content).withColumn("_time", time)
    if unreadable is not None:
        rows = rows.observe(unreadable, F.count_if(F.col("_time").isNull()).alias("rows"))
    rows = rows.where(F.col("_time").isNotNull())
    if not spec.event_key:
        rows = number_copies(rows)
        spec = dataclasses.replace(spec, event_key="_event_key")
    return to_canonical(rows.withColumn(spec.time, F.col("_time")), spec)


def number_copies(rows: DataFrame) -> DataFrame:
    """Give every row a key: the digest of its content plus, for repeated content, a copy number.

    Copies are alike, so it does not matter which one gets which number. They are expanded from their count, which
    is pre-aggregated: a content repeated very often is never gathered in one task.
    """
    others = [c for c in rows.columns if c != "_content"]
    counted = rows.groupBy("_content").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    last = F.col("_n") - 1
    rare = counted.where(F.col("_n") <= 10_000).withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))
    often = counted.where(F.col("_n") > 10_000)
    often = often.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(last / 10_000))))
    often = often.repartition("_content", "_block").withColumn("_copy", F.explode(
        F.sequence(F.col("_block") * 10_000, F.least(F.col("_block") * 10_000 + 9_999, last))))
    rows = rare.unionByName(often.drop("_block"))
    return (rows.withColumn("_event_key", F.concat_ws("-", F.sha2("_content", 256), F.col("_copy").cast("string")))
            .drop("_content", "_n", "_copy"))


def read_scores(spark: SparkSession, root: str, datasets: list[str] | None = None) -> DataFrame:
    """Read the stored score table; dataset, run, model and level prune partitions."""
    scores = spark.read.parquet(root)
    return scores if datasets is None else scores.where(F.col("dataset").isin(datasets))


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = _quoted(spark.read).option("multiLine", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def unpivot_scores(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Turn columns named score_{model}_{level}_{feature_set} into rows.

    0.0 means "not scored" for the ratio and depth scores and becomes null; the noise flag of DBSCAN keeps its 0.0.
    """
    names = [c for c in wide.columns if c.startswith("score_")]
    long = wide.unpivot(ids, names, "column", "score")
    pattern = "^score_([^_]+)_(L[0-9]_[^_]+)_(.+)$"
    parts = {n: F.regexp_extract("column", pattern, i + 1) for i, n in enumerate(("model", "level", "feature_set"))}
    long = long.withColumns(parts).drop("column")
    unscored = (F.col("score") == 0.0) & (F.col("model") != "DBSCAN")
    return long.withColumn("score", F.when(unscored, F.lit(None)).otherwise(F.col("score")))
