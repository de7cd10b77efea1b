"""Histograms of scores with a stated relative error: bins follow a number's exponent and leading bits.

A bin holds the numbers of one sign that share the binary exponent and the first ``bits`` bits behind the leading one, so
its width is at most 2**-bits of its least number, at every size. Bins do not depend on the data: histograms of
runs, days or partitions are merged by adding counts, and are exact counts themselves. They stand beside exact fitting and
quantiles, for tables where a few thousand bins per key are to stand in for all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scale

BITS = 5


def _exponent(size: Column) -> Column:
    """The binary exponent of a positive number; the logarithm's rounding is mended by comparing with exact powers."""
    e = F.floor(F.log2(size))
    e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    return e.cast("bigint")


def bin_edges(value: Column, bits: int = BITS) -> tuple[Column, Column]:
    """Least and next-greater magnitude of the value's bin, with the value's sign; 0.0 and 0.0 for zero."""
    size = F.abs(value)
    power = F.pow(F.lit(2.0), _exponent(size))
    step = F.floor((size / power - 1.0) * float(1 << bits))
    low, high = (power * (1.0 + (step + i) / float(1 << bits)) for i in (0, 1))
    return tuple(F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * edge) for edge in (low, high))


def histogram(rows: DataFrame, keys: list[str], value: str, bits: int = BITS) -> DataFrame:
    """Per key and bin the edges ``near`` and ``far`` (seen from zero) and the number ``n`` of values; nulls are left out."""
    near, far = bin_edges(F.col(value), bits)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, near.alias("near"), far.alias("far")).agg(
        F.count(F.lit(1)).alias("n"))


def merge(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """One histogram per key from those of finer keys (runs, parts)."""
    return histograms.groupBy(*keys, "near", "far").agg(F.sum("n").alias("n"))


def quantiles(histograms: DataFrame, keys: list[str], points: dict[str, float], limit: int = scale.HOT_ROWS) -> DataFrame:
    """Per key the value at rank floor(q * (n - 1)), up to 2**-(bits + 1) of itself: the middle of the bin it stands in."""
    ranked = scale.running(histograms, keys, ["near", "far"], {"_end": F.col("n")}, limit, whole={"_all": F.sum("n")})
    middle = (F.col("near") + F.col("far")) / 2.0
    out = []
    for name, q in points.items():
        at = F.floor((F.col("_all") - 1) * F.lit(q))
        out.append(F.max(F.when((F.col("_end") - F.col("n") <= at) & (at < F.col("_end")), middle)).alias(name))
    return ranked.groupBy(*keys).agg(*out)
