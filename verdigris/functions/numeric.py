"""Numeric column functions that Spark lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Acklam's rational approximation of the inverse normal distribution function
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, within 3e-9 of the exact one between 0.001 and 0.999."""
    q, tail = p - 0.5, F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
    r = q * q
    outer = _poly(tail, _C) / _poly(tail, _D)
    return F.when(p < _LOW, outer).when(p > 1 - _LOW, -outer).otherwise(_poly(r, _A) * q / _poly(r, _B))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def exact_mean(x: Column) -> Column:
    """The mean of values under a million at twelve decimals, summed exactly: no order of the rows changes it, so equal means are equal numbers."""
    return F.avg(x.cast("decimal(18,12)")).cast("double")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
