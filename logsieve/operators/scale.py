"""Building blocks that keep every task bounded when one key holds much of the data.

* ``heavy_keys`` finds keys too large for a single window task (few by construction).
* ``running`` gives exact running sums per key, split over tasks for heavy keys.
* ``keys_at`` finds the sort key standing at a given position without sorting the data.
* ``lookup_join`` broadcasts a lookup table only after its size was checked.
* ``materialise`` writes an intermediate table to the cluster's shared folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows one window task may hold for one key before the key is split.
HOT_ROWS = 2_000_000
# A heavy key holds more than 1/65,536 of all rows, so there are fewer heavy keys than this.
MAX_HEAVY_KEYS = 65_536
# Target rows per segment of a heavy key, and the most segments made.
SEGMENT_ROWS = 1_000_000
MAX_SEGMENTS = 20_000
# Salts that rows without a key are spread over in a join.
EMPTY_SALTS = 65_536
# Largest lookup table that is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` or, in one local JVM without it, a scratch folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _scratch()


@cache
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="logsieve-")


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage and survives lost executors.

    ``options`` are those of the Parquet writer, with ``__`` for dots.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logsieve/{uuid.uuid4().hex}"
    df.write.options(**{k.replace("__", "."): v for k, v in options.items()}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logsieve_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_logsieve_path", None)
        if path is not None:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)
            df._logsieve_path = None


def filter_by(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi",
              limit: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key stands in ``keys``, or with ``left_anti`` does not (nulls equal each other).

    Up to ``limit`` keys, counted, are broadcast, so the wide rows of ``df`` are not shuffled; more are joined by shuffle.
    """
    keys = materialise(keys.select(*[F.col(c).alias(f"__key_{c}") for c in on]))
    if keys.count() <= (BROADCAST_ROWS if limit is None else limit):
        keys = F.broadcast(keys)
    return df.join(keys, reduce(lambda a, c: a & c, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in on]), how)


def heavy_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS,
               total: int | None = None) -> tuple[DataFrame | None, int]:
    """Keys with more rows than ``limit`` (and than 1/65,536 of the table), with their total row count.

    A table of at most ``limit`` rows is answered from its row count alone.
    """
    total = df.count() if total is None else total
    if total <= limit:
        return None, 0
    bar = max(limit, total // MAX_HEAVY_KEYS)
    if not keys:
        return (df.sparkSession.range(1).select(F.lit(total).alias("_n")), total) if total > bar else (None, 0)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bar).collect()
    if not rows:
        return None, 0
    schema = df.select(*keys, F.lit(0).cast("bigint").alias("_n")).schema
    return df.sparkSession.createDataFrame(rows, schema), sum(r["_n"] for r in rows)


def part_heavy(df: DataFrame, keys: list[str], order: list[str], limit: int = HOT_ROWS, total: int | None = None):
    """Split ``df`` into light rows and heavy rows.

    The heavy rows come back range-partitioned by key and order, stored, and tagged with ``_seg``: the number of
    the range they fell into. Segments of one key ascend in ``order`` and each fits one task. The heavy part is
    None when no key is heavy.
    """
    heavy, heavy_rows = heavy_keys(df, keys, limit, total)
    if heavy is None:
        return df, None
    parts = min(MAX_SEGMENTS, max(2, -(-heavy_rows // min(SEGMENT_ROWS, limit))))
    if keys:
        found = F.broadcast(heavy.select(*keys))
        light, hot = df.join(found, keys, "left_anti"), df.join(found, keys, "left_semi")
    else:
        light, hot = df.where(F.lit(False)), df
    hot = hot.repartitionByRange(parts, *keys, *order).withColumn("_seg", F.spark_partition_id())
    return light, materialise(hot)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
            limit: int = HOT_ROWS, total: int | None = None, whole: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums (current row included) per ``keys`` along ``order``, which must be a total order.

    ``whole`` adds aggregates over all rows of the key. ``total``, the number of rows or an upper bound of it, saves
    counting them.
    """
    whole = whole or {}
    light, hot = part_heavy(df, keys, order, limit, total)

    def frame(extra):
        return (Window.partitionBy(*keys, *extra).orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    out = light.withColumns({name: F.sum(c).over(frame([])) for name, c in sums.items()})
    if whole:
        out = out.withColumns({name: c.over(Window.partitionBy(*keys)) for name, c in whole.items()})
    if hot is None:
        return out
    earlier = (Window.partitionBy(*keys).orderBy("_seg")
               .rowsBetween(Window.unboundedPreceding, -1))
    # One row per segment and key: at most MAX_SEGMENTS + MAX_HEAVY_KEYS rows.
    offsets = (hot.groupBy(*keys, "_seg").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
               .select(*keys, "_seg", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}")
                                        for n in sums]))
    hot = hot.withColumns({name: F.sum(c).over(frame(["_seg"])) for name, c in sums.items()})
    hot = hot.join(F.broadcast(offsets), [*keys, "_seg"])
    hot = hot.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
    if whole:
        # One row per heavy key.
        facts = hot.groupBy(*keys).agg(*[c.alias(n) for n, c in whole.items()])
        hot = hot.join(F.broadcast(facts), keys)
    hot = hot.select(*out.columns)
    return out.unionByName(hot)


def lookup_join(left: DataFrame, table: DataFrame, on: list[str], rows: int | None = None, how: str = "left",
                limit: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, *,
                base: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Join to a lookup table with one or few rows per key; ``left`` is read once, however many lookups are chained.

    Up to ``limit`` rows the table is broadcast and ``left`` is not shuffled. A larger one is joined by shuffle on the
    key and a salt: rows of heavy keys are spread over salts, to each of which the few table rows of such a key are
    copied, and rows without key, which match nothing, over many. ``rows`` is the size of a stored table or an upper
    bound; without it the table is stored here and counted. ``base`` is a stored table with the same keys as ``left``
    in which heavy keys are looked for, so that a long plan is not run for that. ``counts`` is a stored table that already
    has the rows of ``left`` for every key, as ``_n``.
    """
    if rows is None:
        table = materialise(table)
        rows = table.count()
    if rows <= limit:
        return left.join(F.broadcast(table), on, how)
    keyed = reduce(lambda a, c: a & c, [F.col(c).isNotNull() for c in on])
    if counts is None:
        heavy, _ = heavy_keys((left if base is None else base).select(*on).where(keyed), on, hot_rows)
    else:
        # At most rows / hot_rows of them, and no more than MAX_HEAVY_KEYS.
        bar = max(hot_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // MAX_HEAVY_KEYS)
        found = counts.where(F.col("_n") > bar).select(*on, "_n").collect()
        heavy = left.sparkSession.createDataFrame(found, counts.select(*on, "_n").schema) if found else None
    spread = F.xxhash64(*[F.col(c) for c, t in left.dtypes if "map<" not in t])
    salts = F.lit(1)
    if heavy is not None:
        share = F.ceil(F.col("_n") / min(SEGMENT_ROWS, hot_rows)).cast("int")
        heavy = F.broadcast(heavy.select(*on, share.alias("__salts")))
        left, table = left.join(heavy, on, "left"), table.join(heavy, on, "left")
        salts = F.coalesce("__salts", F.lit(1))
    left = left.withColumn("__salt", F.when(keyed, F.pmod(spread, salts)).otherwise(F.pmod(spread, F.lit(EMPTY_SALTS))))
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts.cast("bigint") - 1)))
    return left.drop("__salts").join(table.drop("__salts"), [*on, "__salt"], how).drop("__salt")


def keys_at(df: DataFrame, targets: dict, low: int, high: int, rows: int | None = None, take: int = 2_000,
            digits: int = 12) -> dict:
    """The (v, tie) pair standing at 0-based positions of ``df`` ordered by ``v, tie`` within each ``g``.

    ``df`` has columns ``g`` STRING, ``v`` BIGINT in [low, high] and ``tie`` STRING; ``targets`` maps any id to
    (g, position); ``rows`` is the number of rows, if known. Radix selection: each round counts at most 2**digits
    buckets per target and keeps the one holding the position, until the rest fits in ``take`` rows. Equal values are
    narrowed further by prefixes of ``tie``. Only counts and the last few rows reach the driver; the data is scanned,
    not sorted or shuffled.
    """
    bits = max(1, int(high - low).bit_length())
    # A table this small is fetched at once, without counting rounds.
    small = rows is not None and rows <= 10 * take
    state = {str(i): {"id": t, "g": g, "pos": p, "low": low, "bits": bits, "prefix": "", "few": small}
             for i, (t, (g, p)) in enumerate(targets.items())}
    found = {}

    def narrowed(ids):
        """Rows still in question, once per target, with the target's range."""
        entries = {}
        for i in ids:
            s = state[i]
            entries.setdefault(s["g"], []).append(F.struct(
                F.lit(i).alias("t"), F.lit(s["low"]).cast("bigint").alias("low"),
                F.lit(s["low"] + (1 << s["bits"]) - 1).cast("bigint").alias("high"),
                F.lit(max(0, s["bits"] - digits)).alias("shift"), F.lit(s["prefix"]).alias("prefix")))
        mine = F.lit(None)
        for g, structs in entries.items():
            mine = F.when(F.col("g") == g, F.array(*structs)).otherwise(mine)
        return (df.withColumn("_s", F.explode(mine)).select("v", "tie", "_s.*")
                .where(F.col("v").between(F.col("low"), F.col("high"))
                       & F.startswith("tie", "prefix")))

    while state:
        few = [i for i, s in state.items() if s["few"]]
        if few:
            rest = {}
            for r in narrowed(few).select("t", "v", "tie").collect():
                rest.setdefault(r["t"], []).append((r["v"], r["tie"]))
            for i in few:
                s = state.pop(i)
                found[s["id"]] = sorted(rest.get(i, []))[s["pos"]]
            continue
        single = F.col("high") == F.col("low")
        bucket = F.when(~single, F.expr("shiftright(v - low, shift)"))
        # Where a single value is left: go on with two more characters of the tie breaker.
        mark = F.when(single, F.expr("substring(tie, length(prefix) + 1, 2)"))
        rest = {}
        for r in narrowed(state).groupBy("t", bucket.alias("b"), mark.alias("m")).agg(
                F.count(F.lit(1)).alias("n")).collect():
            rest.setdefault(r["t"], []).append((r["b"] or 0, r["m"] or "", r["n"]))
        for i, s in list(state.items()):
            seen = 0
            for b, m, n in sorted(rest.get(i, [])):
                if s["pos"] < seen + n:
                    break
                seen += n
            else:
                raise ValueError(f"position {s['pos']} lies outside group {s['g']}")
            s["pos"] -= seen
            s["few"] = n <= take
            if s["bits"] == 0 and len(m) < 2:
                # The whole tie breaker is read: all rows of the bucket carry it.
                found[state.pop(i)["id"]] = (s["low"], s["prefix"] + m)
            elif s["bits"] > 0:
                shift = max(0, s["bits"] - digits)
                s["low"], s["bits"] = s["low"] + (b << shift), shift
            else:
                s["prefix"] += m
    return found
