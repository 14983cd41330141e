"""Order-preserving scales, used to cut value ranges into bins without sorting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF_BIN = 1 << 40


def root64(x: Column) -> Column:
    """sign(x) |x|^(1/64): six square roots.

    IEEE square roots are correctly rounded, so the scale is exactly monotone on every machine, and it
    brings 1e-308 .. 1e308 within a factor of about 65,000, so long tails do not swallow the bins.
    """
    y = F.abs(x)
    for _ in range(6):
        y = F.sqrt(y)
    return F.when(x < 0, -y).otherwise(y)


def fixed_bin(x: Column, per_unit: int = 2048) -> Column:
    """Bin of a double on a scale that is the same for all data, so that counts of separate loads add up."""
    inf = float("inf")
    return F.when(x == inf, F.lit(INF_BIN)).when(x == -inf, F.lit(-INF_BIN)).otherwise(F.floor(root64(x) * F.lit(float(per_unit)))).cast("bigint")


def nan_to_null(x: Column) -> Column:
    """NaN is no value."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
