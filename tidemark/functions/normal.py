"""The normal distribution as column arithmetic: rational approximations that any SQL engine can state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerator and denominator of the tail over exp(-x * x / 2) for |x| < 7.07 (Hart 1968), highest power first.
TAIL = (
    (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)
#: The quantile's middle part and its tails (Acklam 2003), highest power first, and where the tails begin.
MIDDLE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
)
TAILS = (
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)
LOW = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda y, c: y * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(x: Column) -> Column:
    """The share below x; exact to 15 digits, 0 or 1 beyond 37."""
    a = F.abs(x)
    scale = F.exp(-a * a / 2)
    far = scale / ((a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) * 2.506628274631)
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, scale * _poly(a, TAIL[0]) / _poly(a, TAIL[1])).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The x below which a share p lies, with a relative error of 1e-9; null outside (0, 1)."""
    q = p - 0.5
    middle = q * _poly(q * q, MIDDLE[0]) / _poly(q * q, MIDDLE[1])

    def tail(share: Column) -> Column:
        r = F.sqrt(-2 * F.log(share))
        return _poly(r, TAILS[0]) / _poly(r, TAILS[1])

    return F.when((p > 0) & (p < LOW), tail(p)).when((p > 1 - LOW) & (p < 1), -tail(1 - p)).when((p > 0) & (p < 1), middle)
