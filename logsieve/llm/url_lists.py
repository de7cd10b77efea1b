"""URL filtering against dated lists: entries become validity intervals, captures are joined as of their fetch time.

List events say that on a date a pattern was added to or removed from a list. Patterns are whole hosts (``host``),
domains with all their subdomains (``domain``) or a host with a path prefix (``prefix``). An entry is active from the
date of its addition up to, and without, the date of its next removal.

Defined results: a null or unreadable URL, or a null fetch time, matches nothing; events with a null field are ignored;
of several events of one pattern on one date a removal wins, and repeating an addition changes nothing; repeated
captures each get a row; empty tables give no rows or no matches; other columns of the captures stay, but those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import hash32


def host_of(url: Column) -> Column:
    """Lower-case host without credentials, port and closing dot; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """``list, kind, pattern, event_date, action`` to ``list, kind, pattern, valid_from, valid_to`` (null: still active).

    One window per (list, pattern); a pattern's own events are few.
    """
    named = events.dropna(subset=["list", "kind", "pattern", "event_date", "action"])
    state = (named.groupBy("list", "kind", "pattern", "event_date")
             .agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("_on")))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("event_date")
    changes = state.withColumn("_was", F.lag("_on", 1, 0).over(w)).where(F.col("_on") != F.col("_was"))
    return (changes.withColumn("valid_to", F.lead("event_date").over(w)).where(F.col("_on") == 1)
            .select("list", "kind", "pattern", F.col("event_date").alias("valid_from"), "valid_to"))


def _month(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")


def _keys(deepest: int) -> Column:
    """Every (kind, pattern) that could match the row's host and path; prefixes up to the deepest on the lists."""
    labels = F.split("_host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.slice(F.filter(F.split("_path", "/"), lambda x: x != ""), 1, max(1, deepest))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat(F.col("_host"), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern"))))
    hosts = F.array(F.struct(F.lit("host").alias("kind"), F.col("_host").alias("pattern")))
    return F.concat(hosts, domains, F.coalesce(prefixes, F.filter(hosts, lambda x: F.lit(False))))


def filter_captures(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``n_active``, ``lists`` (comma-joined) and the first active entry to ``url, fetched`` captures.

    Each distinct (url, fetched) pair is evaluated once, which also folds repeated captures before any shuffle by host.
    Entries are repeated for every month of their validity in which anything was fetched, and the join is on (kind,
    pattern, month): a popular host spreads over months, and an entry that was switched often is only compared within
    one month.
    """
    seen = captures.agg(F.min("fetched"), F.max("fetched")).first()
    deepest = spans.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    pairs = captures.select("url", "fetched").where("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    pairs = pairs.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))}).where("_host != ''")
    wanted = pairs.select("url", "fetched", _month(F.col("fetched")).alias("_month"),
                          F.explode(F.array_distinct(_keys(deepest))).alias("_k")).select(
                              "url", "fetched", "_month", "_k.*")
    low, high = F.lit(seen[0]).cast("date"), F.lit(seen[1]).cast("date")
    start = F.greatest(F.col("valid_from"), low)
    stop = F.least(F.coalesce(F.date_sub("valid_to", 1), high), high)
    monthly = spans.where(start <= stop).withColumn("_month", F.explode(F.sequence(_month(start), _month(stop))))
    hits = wanted.join(monthly, ["kind", "pattern", "_month"]).where(
        (F.col("valid_from") <= F.col("fetched"))
        & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    # Lists and active entries per capture are few: bounded by the keys of one URL times the lists.
    verdict = hits.groupBy("url", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.min(F.struct("list", "kind", "pattern", "valid_from", "valid_to")).alias("_first"))
    verdict = verdict.select("url", "fetched", "n_active", "lists", F.concat_ws(
        ":", "_first.list", "_first.kind", "_first.pattern").alias("entry"),
        F.col("_first.valid_from").alias("valid_from"), F.col("_first.valid_to").alias("valid_to"))
    captures = captures.drop("n_active", "lists", "entry", "valid_from", "valid_to", "blocked")
    return (captures.join(verdict, ["url", "fetched"], "left")
            .withColumn("n_active", F.coalesce("n_active", F.lit(0)).cast("bigint"))
            .withColumn("blocked", F.col("n_active") > 0))


FIRST_DAY = "2024-01-01"


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date drawn from the page id: the table carries none."""
    day = hash32(F.lit("fetched"), F.col("page_id").cast("string")) % 366
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")).alias("fetched"))


def list_events(pages: DataFrame) -> DataFrame:
    """Three dated lists over the hosts, domains and first path segments that occur in the table, drawn by hash."""
    urls = pages.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).where("h != ''").distinct()
    labels = F.split("h", r"\.")
    named = urls.select("h", F.explode(F.array(
        F.struct(F.lit("malware").alias("list"), F.lit("host").alias("kind"), F.col("h").alias("pattern"),
                 F.lit(3).alias("every")),
        F.struct(F.lit("adult").alias("list"), F.lit("domain").alias("kind"),
                 F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").alias("pattern"),
                 F.lit(5).alias("every")),
        F.struct(F.lit("spam").alias("list"), F.lit("prefix").alias("kind"),
                 F.concat(F.col("h"), F.lit("/"), F.element_at(F.filter(F.split("p", "/"), lambda x: x != ""), 1))
                 .alias("pattern"), F.lit(4).alias("every")))).alias("e")).select("e.*")
    named = named.where("pattern IS NOT NULL").distinct()
    h = hash32(F.col("list"), F.col("kind"), F.col("pattern"))
    named = named.withColumn("h", h).where(F.col("h") % F.col("every") == 0)
    start = F.lit(FIRST_DAY).cast("date")
    first = (F.floor(F.col("h") / 60) % 250).cast("int")
    length = (F.floor(F.col("h") / 15_000) % 90 + 5).cast("int")
    pause = (F.floor(F.col("h") / 1_350_000) % 40 + 1).cast("int")
    steps = F.array(F.struct(first.alias("d"), F.lit("add").alias("a")),
                    F.struct((first + length).alias("d"), F.lit("remove").alias("a")),
                    F.struct((first + length + pause).alias("d"), F.lit("add").alias("a")))
    return named.select("list", "kind", "pattern", F.explode(steps).alias("s")).select(
        "list", "kind", "pattern", F.date_add(start, F.col("s.d")).alias("event_date"), F.col("s.a").alias("action"))
