"""Column expressions that the operators are made of."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantiser weights of the temporal levels, and the gains of prediction and update.
HIGH_WEIGHTS = (1.0, 0.92470128353329, 0.99029103222357, 1.12001265233249, 1.28641274725767, 1.48343269251745, 1.71234593056217, 1.97708086092642)
LOW_WEIGHTS = (1.0, 1.10554159678513, 1.26197963240006, 1.45296631451356, 1.67651411818611, 1.93551742673391, 2.23484071726601, 2.58054224785086)
ALPHA, BETA = (23 / 32) ** 0.5, 1.5**0.5


def copy_weight(kind: str, level: int) -> float:
    """Gain of a copied high or low frame at a level: the low weight above it over its own, over alpha or beta."""
    own, gain = (HIGH_WEIGHTS, ALPHA) if kind == "H" else (LOW_WEIGHTS, BETA)
    return (LOW_WEIGHTS[level - 1] / own[level] if level else 1.0) / gain


def clip_round(c: Column, low: float = 0, high: float = 255, offset: float = 0) -> Column:
    """Rounded half away from zero after an offset, within low..high."""
    return F.least(F.greatest(F.round(c + offset), F.lit(float(low))), F.lit(float(high)))


def quantize(c: Column, scale: Column | float) -> Column:
    """Dead-zone quantiser: truncates towards zero."""
    return F.signum(c) * F.floor(F.abs(c / scale))


def dequantize(q: Column, scale: Column | float, mode: str = "midpoint") -> Column:
    """`plain` is q * scale; `midpoint` adds half a step away from zero, and 0 stays 0."""
    s = F.lit(scale) if not isinstance(scale, Column) else scale
    return q * s if mode == "plain" else F.when(q == 0, F.lit(0.0)).otherwise(F.signum(q) * (F.abs(q) + 0.5) * s)


def plane_midpoint(q: Column, plane: int) -> Column:
    """Magnitude known down to a bit plane, with the bit below it set: 0 stays 0."""
    known = F.shiftleft(F.shiftright(F.abs(q), plane), plane)
    return F.when(known == 0, F.lit(0)).otherwise(F.signum(q.cast("double")).cast("int") * known.bitwiseOR(F.shiftright(F.lit(1 << plane), 1)))


def soft_round(c: Column, alpha: float) -> Column:
    """A differentiable rounding: m + tanh(alpha * r) / (2 * tanh(alpha / 2)) around the middle m of the step."""
    m = F.floor(c) + 0.5
    return m + F.tanh(alpha * (c - m)) / (2 * F.tanh(F.lit(alpha / 2)))


def noisy_soft_round(c: Column, alpha: float, seed: int) -> Column:
    """soft_round, uniform noise in +-0.5, soft_round."""
    return soft_round(soft_round(c, alpha) + F.rand(seed) - 0.5, alpha)


def psnr(mse: Column, peak: float = 255) -> Column:
    """Decibels; NULL where the error is zero."""
    return F.when(mse > 0, 10 * F.log10(F.lit(float(peak * peak)) / mse))


def normal_tail(z: Column) -> Column:
    """Mass of the standard normal distribution above z >= 0, to 1e-14: a power series below 3, a continued fraction from there on."""
    square, density = z * z, F.exp(-z * z / 2) / (2 * pi) ** 0.5
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(48), F.lit(1.0), lambda s, k: 1 + s * square / (2 * k + 1))
    fraction = F.aggregate(down(60), z, lambda f, k: z + k / f)
    return F.when(z < 3, 0.5 - density * z * series).otherwise(density / fraction)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    return F.when(z < 0, normal_tail(-z)).otherwise(1 - normal_tail(z))


def normal_mass(low: Column, high: Column) -> Column:
    """Mass of the standard normal distribution between low <= high; tails are subtracted on one side, so small masses stay exact."""
    one_side = lambda a, b: normal_tail(a) - normal_tail(b)
    return F.when(low >= 0, one_side(low, high)).when(high <= 0, one_side(-high, -low)).otherwise(1 - normal_tail(-low) - normal_tail(high))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.sort_array(F.array(a, b, c))[1]
