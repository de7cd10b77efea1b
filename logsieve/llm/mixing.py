"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of words from its weight; budgets stop at ``cap`` times the source's own words and the excess
goes to the others by weight. Whole epochs of a source come first. The fraction left is drawn without replacement:
every document has the key -ln(u) / quality weight, documents are taken in ascending key order while their prefix sum of
words stays within the budget. Draws come from a hash of doc_id, so reruns agree.

No source is sorted as a whole: keys are counted in ranges, ranges below the cut are taken, ranges above are not, and
only rows of the one range that holds the cut are ordered.

Defined results: a null source is a source of its own and the last; a null or empty text has size 0 and is never taken
(``taken`` 0); repeated rows are documents of their own; a table without words gives targets of 0; other columns are
ignored; a null doc_id draws like the text ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scale
from .sharding import hash32

SEED = "mix-1"
SHARE, CAP = 1.5, 2.0
WEIGHTS = (3, 1, 2)
RANGES = 4_096
RANGE_ROWS = 50_000


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.1 and 1: falls with the share of symbol characters per word."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - F.coalesce(symbols, F.lit(0)) / F.greatest(size, F.lit(1)).cast("double"))


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS) -> DataFrame:
    """``source, source_size`` to the target of each source. One row per source.

    Sorted by size over weight, the sources that stop at their cap are a prefix; the rest share what is left by weight.
    Sources are ordered by code point, null last.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * cap)
    whole = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumns({
        "_left": total * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_open": F.sum("_w").over(Window.partitionBy(F.lit(0)))
        - F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    # Water level per unit of weight if this source is the first that is not capped.
    rows = rows.withColumn("_level", F.when(F.col("_left") * F.col("_w") < F.col("_cap") * F.col("_open"),
                                            F.col("_left") / F.col("_open")))
    level = F.first("_level", ignorenulls=True).over(
        whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_l", level).select(
        "source", "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_l") * F.col("_w"), F.col("_cap"))).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the sampling key (a non-negative integer), one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "text", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
                       .cast("bigint").alias("size"))
    u = (hash32(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) + 0.5) / float(1 << 32)
    # The largest possible key is ln(2**33) / 0.1 < 2**8; 32 more bits keep ties rare.
    key = F.floor(-F.log(u) / quality_weight(F.col("text"), F.col("size")) * float(1 << 32)).cast("bigint")
    return rows.select("doc_id", "source", "size", key.alias("_key"))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS, ranges: int = RANGES,
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row per document.

    ``copies`` is how often the document is used and ``taken`` = copies * size. The document at the cut is taken when
    that brings its source nearer to the target.
    """
    rows = scale.materialise(sized(docs))
    ranges = max(ranges, rows.count() // range_rows)
    # Rising with the key, and within a small factor of even for any blend of weights between 0.1 and 1.
    spread = [1.0 - F.exp(F.col("_key") * (-w / float(1 << 32))) for w in (0.1, 0.2, 0.5, 1.0)]
    rows = rows.withColumn("_b", F.floor((spread[0] + spread[1] + spread[2] + spread[3]) * (ranges / 4.0)).cast("int"))
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    goals = targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), share, cap, weights)
    goals = goals.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                             .otherwise(F.lit(0)).cast("bigint"))
    goals = goals.withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    # At most ``ranges`` rows per source.
    by = Window.partitionBy("source").orderBy("_b")
    sums = sums.withColumn("_end", F.sum("_n").over(by)).withColumn("_start", F.col("_end") - F.col("_n"))
    cuts = (sums.join(goals, sums["source"].eqNullSafe(goals["source"])).drop(goals["source"])
            .groupBy("source", "source_size", "target", "_epochs", "_budget")
            .agg(F.min(F.when(F.col("_end") >= F.col("_budget"), F.struct("_b", "_start"))).alias("_cut")))
    # One row per source, so this is broadcast wherever the sources fit, and joined by shuffle elsewhere.
    cuts = cuts.select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_budget",
                       F.coalesce(F.col("_cut._b"), F.lit(ranges + 1)).alias("_cut_b"),
                       F.coalesce(F.col("_cut._start"), F.lit(0)).alias("_cut_start"))
    out = rows.join(cuts, rows["source"].eqNullSafe(cuts["_source"])).drop("_source")
    near = out.where(F.col("_b") == F.col("_cut_b"))
    seq = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_cut_start") + F.sum("size").over(seq) - F.col("size") / 2.0
    near = near.withColumn("_take", middle <= F.col("_budget"))
    rest = out.where(F.col("_b") != F.col("_cut_b")).withColumn("_take", F.col("_b") < F.col("_cut_b"))
    both = rest.unionByName(near)
    copies = F.when(F.col("size") > 0, F.col("_epochs") + F.col("_take").cast("bigint")).otherwise(F.lit(0))
    return both.withColumn("copies", copies.cast("bigint")).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Copies are looked up by doc_id, source and size, which are the same for repeated rows.
    """
    plan = mix(docs, **options).where("copies > 0").groupBy("doc_id", "source", "size").agg(
        F.max("copies").alias("copies"))
    plan = plan.toDF("__mix_id", "__mix_source", "__mix_size", "__mix_copies")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source"))
                     & (size == F.col("__mix_size")))
    return rows.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(
        *[docs[c] for c in docs.columns])
