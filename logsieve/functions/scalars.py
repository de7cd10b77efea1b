"""Scalar column expressions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_DAY = 86_400 * US_PER_SECOND
HASH_RANGE = 1 << 32


def micros(time: str) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, without touching the session zone."""
    t = F.col(time)
    second = (F.extract(F.lit("SECOND"), t) * US_PER_SECOND).cast("bigint")
    minute = (F.hour(t) * 60 + F.minute(t)).cast("bigint")
    return F.unix_date(t.cast("date")) * F.lit(US_PER_DAY) + minute * F.lit(60 * US_PER_SECOND) + second


def add_seconds(time: str, shift_us: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {shift_us}, {time})")


def seconds(us) -> Column:
    return F.col(us) / F.lit(float(US_PER_SECOND))


def fractional_hour(us) -> Column:
    """Hour and minute of day as hours; seconds are left out."""
    minute_of_day = F.floor(F.pmod(us, F.lit(US_PER_DAY)) / F.lit(60 * US_PER_SECOND))
    return F.floor(minute_of_day / 60) + F.pmod(minute_of_day, F.lit(60)) / F.lit(60.0)


def weekday(us) -> Column:
    """Day of week, Monday = 0 (1970-01-01 was a Thursday)."""
    return F.pmod(F.floor(us / F.lit(US_PER_DAY)) + 3, F.lit(7)).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * 3.141592653589793) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def hash_digits(purpose: str, seed: int, run: Column, key: Column) -> Column:
    """The draw of ``hash32`` as 8 hex digits, which stand in the same order."""
    text = F.concat_ws("|", F.lit(str(seed)), run.cast("string"), F.lit(purpose), key)
    return F.substring(F.md5(text), 1, 8)


def hash32(purpose: str, seed: int, run: Column, key: Column) -> Column:
    """Reproducible 32-bit draw per (run, key): the first 8 hex digits of an md5."""
    return F.conv(hash_digits(purpose, seed, run, key), 16, 10).cast("bigint")


def uniform(purpose: str, seed: int, run: Column, key: Column) -> Column:
    return hash32(purpose, seed, run, key) / F.lit(float(HASH_RANGE))


def normal(purpose: str, seed: int, run: Column, key: Column) -> Column:
    """Standard normal draw per (run, key) by the Box-Muller formula."""
    u1 = (hash32(purpose + ":r", seed, run, key) + 1) / F.lit(float(HASH_RANGE + 1))
    u2 = uniform(purpose + ":a", seed, run, key)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * 3.141592653589793) * u2)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + F.lit(1e-6))


def momentum_ratio(delta: Column, recent_mean: Column) -> Column:
    return delta / (recent_mean + F.lit(1e-6))


def event_density(index: Column, elapsed: Column) -> Column:
    return index / (elapsed + F.lit(1.0))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the denominator is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def dataset_label(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(".csv"), F.lit("")))


def three_decimals(value: Column) -> Column:
    return F.format_string("%.3f", value)
