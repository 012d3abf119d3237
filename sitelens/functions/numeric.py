"""Numbers and time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def floor_div(a: Column, b: int) -> Column:
    """Integer floor division for longs (also right for negative ``a``)."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, floored (negative when later < earlier)."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return floor_div(micros, MICROS_PER_DAY)


def _excess(k: str, half: str, nd: int) -> str:
    """(2k + 1) - 2 * 10^nd * half as SQL text, exact: the factor is split into powers of two."""
    factor, text = 2 * 10 ** nd, f"(2.0e0 * {k} + 1.0e0)"
    for bit in sorted((1 << i for i in range(factor.bit_length()) if factor >> i & 1), reverse=True):
        text = f"({text} - {bit}.0e0 * {half})"
    return text


def py_round(x: Column, nd: int) -> Column:
    """Round a non-negative double to ``nd`` (1 or 2) decimals exactly as Python's ``round``.

    Python rounds the exact binary value, half to even.  k0 = floor(x*10^nd) is
    at most one off; the half-way point between k0 and k0+1 is compared with x
    as a correctly-rounded double.  When they are equal, the sign of an exact
    residual tells on which side of the true half-way point that double lies.
    """
    scale = 10 ** nd
    k0 = F.floor(x * F.lit(float(scale))).cast("long")
    half = F.concat(k0.cast("string"), F.lit(f"5e-{nd + 1}")).cast("double")
    excess = F.lit(2.0) * k0.cast("double") + F.lit(1.0)
    factor = 2 * scale
    for bit in sorted((1 << i for i in range(factor.bit_length()) if factor >> i & 1), reverse=True):
        excess = excess - F.lit(float(bit)) * half
    tie_up = (excess < 0) | ((excess == 0) & (k0 % 2 == 1))
    up = (x > half) | ((x == half) & tie_up)
    return (k0 + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale))


def py_round_sql(x: str, nd: int) -> str:
    """The same rounding as a DuckDB SQL expression (for oracles)."""
    scale = 10 ** nd
    k0 = f"CAST(floor(({x}) * {float(scale)}) AS BIGINT)"
    half = f"CAST(CAST({k0} AS VARCHAR) || '5e-{nd + 1}' AS DOUBLE)"
    excess = _excess(k0, half, nd)
    tie = f"({excess} < 0 OR ({excess} = 0 AND {k0} % 2 = 1))"
    up = f"(({x}) > {half} OR (({x}) = {half} AND {tie}))"
    return f"(CAST({k0} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / {float(scale)})"
