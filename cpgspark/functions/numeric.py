"""Column expressions for methylation values.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """NaN and infinities become null; everything else is unchanged."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def to_number(value: Column) -> Column:
    """Text to double; what is not a finite number becomes null."""
    return finite(value.try_cast("double"))


def clean_numeric(value: Column) -> Column:
    """Not a finite number counts as 0; single precision."""
    return F.coalesce(to_number(value), F.lit(0.0)).cast("float")


def beta_to_m(beta: Column, alpha: float = 1e-6) -> Column:
    """M value of a beta value kept inside [alpha, 1 - alpha]."""
    kept = F.least(F.greatest(beta, F.lit(alpha)), F.lit(1 - alpha))
    return F.when(beta.isNotNull(), F.log2(kept / (1 - kept)))


def m_to_beta(m: Column) -> Column:
    """Beta value of an M value, written so that large M cannot overflow."""
    return 1 / (1 + F.pow(F.lit(2.0), -m))


def signal_to_m(methylated: Column, unmethylated: Column, offset: float) -> Column:
    """log2 ratio of the two signals, each raised by ``offset``."""
    return F.log2(F.try_divide(methylated + offset, unmethylated + offset))


def signal_to_beta(methylated: Column, unmethylated: Column, offset: float) -> Column:
    """Methylated share of the total signal."""
    return F.try_divide(methylated, methylated + unmethylated + offset)
