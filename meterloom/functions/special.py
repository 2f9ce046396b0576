"""Distribution functions that Spark lacks, as expressions: Student's t by the incomplete beta function, the normal tails."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, and how far its argument is moved up.
STIRLING, MOVED = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360), 8
TINY, CLOSE = 1e-300, 1e-15


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0, to some 1e-13."""

    def series(y: Column) -> Column:
        rest = sum((F.lit(c) / F.pow(y, F.lit(2 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + rest

    def moved(x: Column) -> Column:
        below = x
        for i in range(1, MOVED):
            below = below * (x + i)
        return let(x + MOVED, series) - F.log(below)

    return let(x, moved)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function (modified Lentz); it needs about the root of the larger parameter in steps."""
    safe = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    state = lambda c, d, h, e: F.struct(c.alias("c"), d.alias("d"), h.alias("h"), e.alias("e"))

    def half(s: Column, num: Column) -> Column:
        both = let(num, lambda n: F.struct(safe(1 + n / s["c"]).alias("c"), (1 / safe(1 + n * s["d"])).alias("d")))
        return let(both, lambda v: state(v["c"], v["d"], s["h"] * v["c"] * v["d"], F.abs(v["c"] * v["d"] - 1)))

    def step(s: Column, m: Column) -> Column:
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s["e"] < CLOSE, s).otherwise(let(half(s, even), lambda t: half(t, odd)))

    first = let(1 / safe(1 - (a + b) * x / (a + 1)), lambda d: state(F.lit(1.0), d, d, F.lit(1.0)))
    steps = F.sequence(F.lit(1), (200 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(steps, first, step, lambda s: s["h"])


def betainc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function."""

    def of(p: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        # the fraction is taken on the side where it converges fast
        low = x < (a + 1) / (a + b + 2)
        side = F.when(low, F.struct(a.alias("a"), b.alias("b"), x.alias("x"))).otherwise(F.struct(b.alias("a"), a.alias("b"), (1 - x).alias("x")))
        part = let(side, lambda s: front * _fraction(s["a"], s["b"], s["x"]) / s["a"])
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(let(part, lambda v: F.when(low, v).otherwise(1 - v)))

    return let(F.struct(*[v.cast("double").alias(n) for n, v in (("a", a), ("b", b), ("x", x))]), of)


def t_two_tails(t: Column, df: Column) -> Column:
    """P(|T| >= |t|): no difference of near numbers, so small values are exact."""
    return betainc(df / 2, F.lit(0.5), df / (df + t * t))


def t_cdf(t: Column, df: Column) -> Column:
    return let(t_two_tails(t, df), lambda p: F.when(t > 0, 1 - p / 2).otherwise(p / 2))


def t_central(level: Column, df: Column) -> Column:
    """q with P(|T| <= q) = level. The tails fall and are convex, so Newton's steps from 0 come nearer from one side."""
    scale = let(log_gamma((df + 1) / 2) - log_gamma(df / 2), lambda g: F.exp(g) / F.sqrt(df * math.pi))

    def solved(k: Column) -> Column:
        density = lambda q: k * F.pow(1 + q * q / df, -(df + 1) / 2)
        near = lambda q: let((t_two_tails(q, df) - (1 - level)) / (2 * density(q)), lambda s: F.struct((q + s).alias("q"), F.abs(s).alias("e")))
        step = lambda s, _: F.when(s["e"] < 1e-13 * (1 + s["q"]), s).otherwise(near(s["q"]))
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(F.lit(0.0).alias("q"), F.lit(1.0).alias("e")), step, lambda s: s["q"])

    return let(scale, solved)


def normal_two_tails(z: Column) -> Column:
    """P(|Z| >= |z|): near 0 by the series of odd powers, beyond by the continued fraction, which is exact for small values too."""

    def of(x: Column) -> Column:
        density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        term = lambda s, j: let(s["t"] * x * x / (2 * j + 1), lambda t: F.struct((s["s"] + t).alias("s"), t.alias("t")))
        near = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(x.alias("s"), x.alias("t")), term, lambda s: 1 - 2 * density * s["s"])
        far = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), x, lambda s, j: x + j / s, lambda s: 2 * density / s)
        return F.when(x < 3, near).otherwise(far)

    return let(F.abs(z).cast("double"), of)
