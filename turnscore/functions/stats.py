"""A5_corr_pvalue: the regularized incomplete beta by Lentz's continued
fraction, in plain Python (for single values) and as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Degrees of freedom from which Student's t is taken as normal, with Wallace's
#: correction (an error below 1e-9 there).
NORMAL_FROM = 100_000


def _beta_cf(a: float, b: float, x: float, max_iter: int = 10_000, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            return h
    raise ArithmeticError(f"incomplete beta did not converge for a={a}, b={b}, x={x}")


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta ``I_x(a, b)``."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def correlation_pvalue(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs (Student t
    with ``n - 2`` degrees of freedom)."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2
    rest = (1.0 - r) * (1.0 + r)
    # -log(1 - r**2) keeps its digits for a small r
    spread = -math.log1p(-r * r)
    if dof >= NORMAL_FROM:
        # z with the same tail as t = r * sqrt(dof / rest)
        z = math.sqrt(dof * spread) * (1.0 - 1.0 / (4.0 * dof))
        return math.erfc(z / math.sqrt(2.0))
    return betainc(dof / 2.0, 0.5, rest)


# ---------------------------------------------------------------- as columns


def ln_gamma(x: Column) -> Column:
    """log Gamma of a positive column: Stirling's series eight places up, and the
    recurrence back (good to about 1e-14 of its size)."""
    z = x + 8.0
    series = 1 / (12.0 * z) - 1 / (360.0 * z * z * z) + 1 / (1260.0 * F.pow(z, 5)) - 1 / (1680.0 * F.pow(z, 7)) + 1 / (1188.0 * F.pow(z, 9))
    up = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    return up - F.ln(product)


def _nonzero(v: Column) -> Column:
    return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)


def _lentz(terms: Callable[[Column], list[tuple[Column, Column]]], steps: Column, c0: Column, d0: Column, h0: Column) -> Column:
    """A continued fraction by Lentz's method as a fold over ``1..steps``:
    ``terms(m)`` are the (numerator, denominator) pairs of step m. Steps after
    convergence pass the value on; a fraction that doesn't converge is an error."""

    def step(s: Column, m: Column) -> Column:
        c, d, h, delta = s["c"], s["d"], s["h"], F.lit(1.0)
        for over, under in terms(m.cast("double")):
            d = 1 / _nonzero(under + over * d)
            c = _nonzero(under + over / c)
            delta = c * d
            h = h * delta
        moved = F.struct(c.alias("c"), d.alias("d"), h.alias("h"), (F.abs(delta - 1) < 1e-15).alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    start = F.struct(c0.alias("c"), d0.alias("d"), h0.alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, step,
                       lambda s: F.when(s["done"] | s["h"].isNull(), s["h"]).otherwise(F.raise_error(F.lit("a continued fraction did not converge")).cast("double")))


def _steps(size: Column) -> Column:
    return 80 + F.ceil(8 * F.sqrt(size))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def terms(m):
        return [(m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)), F.lit(1.0)), (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)), F.lit(1.0))]

    d = 1 / _nonzero(1 - (a + b) * x / (a + 1))
    return _lentz(terms, _steps(F.greatest(a, b)), F.lit(1.0), d, d)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution: a continued fraction, and near
    the centre a power series."""
    y = z * z / 2
    far = F.greatest(y, F.lit(1.0))
    start = far + 0.5
    fraction = _lentz(lambda m: [(-m * (m - 0.5), far + 2 * m + 0.5)], F.lit(400), F.lit(1e300), 1 / start, 1 / start)
    upper = F.exp(-far + 0.5 * F.ln(far)) * fraction / math.sqrt(math.pi)
    near = F.least(y, F.lit(1.0))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(2.0).alias("t"), F.lit(2.0).alias("s")),
                        lambda s, n: F.struct((s["t"] * near / (n + 0.5)).alias("t"), (s["s"] + s["t"] * near / (n + 0.5)).alias("s")), lambda s: s["s"])
    lower = F.sqrt(near) * F.exp(-near) * terms / math.sqrt(math.pi)
    return F.when(y >= 1.0, upper).otherwise(1 - lower)


def pvalue(r: Column, n: Column) -> Column:
    """:func:`correlation_pvalue` as a column, evaluated in the JVM."""
    r, dof = r.cast("double"), (n - 2).cast("double")
    known = r.isNotNull() & ~F.isnan(r) & (n >= 3)
    inner = F.least(F.abs(r), F.lit(1 - 1e-16))  # 1 is told apart below
    safe = F.when(known, F.least(dof, F.lit(float(NORMAL_FROM))))
    a, x = safe / 2, (1 - inner) * (1 + inner)
    half = F.lit(0.5)
    front = F.exp(ln_gamma(a + 0.5) - ln_gamma(a) - math.lgamma(0.5) + a * F.ln(x) + 0.5 * F.ln(F.greatest(inner * inner, F.lit(1e-300))))
    left = x < (a + 1) / (a + 2.5)
    exact = F.when(left, front * _beta_fraction(a, half, F.when(left, x)) / a).otherwise(
        1 - 2 * front * _beta_fraction(half, a, F.when(~left, 1 - x)))
    z = F.sqrt(dof * -F.log1p(-inner * inner)) * (1 - 1 / (4 * dof))
    p = F.when(dof >= NORMAL_FROM, normal_tail(F.when(dof >= NORMAL_FROM, z))).otherwise(exact)
    return F.when(known, F.when(F.abs(r) >= 1.0, 0.0).when(r == 0, 1.0).otherwise(p))
