"""Column functions over distributions, floats and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_softmax(logits: str) -> Column:
    """ARRAY<DOUBLE>: logits less the logarithm of the sum of their exponentials, taken from the largest on."""
    shifted = f"transform(array(array_max({logits})), top__ -> top__ + ln(aggregate({logits}, 0D, (sum__, x__) -> sum__ + exp(CAST(x__ AS DOUBLE) - top__))))[0]"
    return F.expr(f"transform(array({shifted}), all__ -> transform({logits}, x__ -> CAST(x__ AS DOUBLE) - all__))[0]")


def cross_entropy(p: str, log_q: str) -> Column:
    """-sum p ln q in nats; a p of 0 adds nothing."""
    return F.expr(f"aggregate(zip_with({p}, {log_q}, (x, y) -> IF(x = 0, 0D, -x * y)), 0D, (a, x) -> a + x)")


def divergence(p: str, log_q: str) -> Column:
    """sum p (ln p - ln q) in nats; a p of 0 adds nothing."""
    return F.expr(f"aggregate(zip_with({p}, {log_q}, (x, y) -> IF(x = 0, 0D, x * (ln(x) - y))), 0D, (a, x) -> a + x)")


def same_bits(a: str, b: str) -> Column:
    """Whether two floats are the same value, zeros of both signs apart, all NaN alike; nulls are the same as nulls."""
    return F.expr(f"CAST({a} AS STRING) <=> CAST({b} AS STRING)")


def record_digest(*columns: str) -> Column:
    """SHA-256 of a record as compact JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def shown_number(value: str, digits: int = 3) -> Column:
    """A number with so many significant digits, at most six decimals, without an exponent; null for null."""
    places = F.greatest(F.lit(0), F.least(F.lit(6), F.lit(digits - 1) - F.floor(F.log10(F.greatest(F.abs(F.col(value)), F.lit(1e-9))))))
    return F.coalesce(*(F.when(F.col(value).isNotNull() & (places == k), F.format_string(f"%.{k}f", F.col(value).cast("double"))) for k in range(7)))


def shown_interval(value: str, low: str, high: str, digits: int = 3) -> Column:
    """value [low, high]; a bound that is missing shows as a mark."""
    return F.concat(F.coalesce(shown_number(value, digits), F.lit("??")), F.lit(" ["), F.coalesce(shown_number(low, digits), F.lit("??")), F.lit(", "), F.coalesce(shown_number(high, digits), F.lit("??")), F.lit("]"))
