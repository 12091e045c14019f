"""Scores and p-values of interactions as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest p-value that is reported.
FLOOR = 1e-10


def gcs(median: Column, largest: Column) -> Column:
    """Complementarity score of a group: median times maximum."""
    return median * largest


def ghs(median: Column, least: Column) -> Column:
    """Energy score of a group: the geometric mean of median and minimum, negative if both are."""
    root = F.sqrt(F.abs(median * least))
    return F.when((median < 0) & (least < 0), -root).otherwise(root)


#: Up to so many successes the tail is summed, beyond it is a continued fraction.
SUMMED = 1000


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z >= 1, by Stirling's series from z + 9 on."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0.0), lambda a, k: a + F.log(z + k))
    y = z + 9.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - up


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2); its steps grow with the root of a + b."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    zero = F.struct(F.lit(1.0).alias("c"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("d"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("h"))

    def half(s: Column, t: Column) -> Column:
        c, d = safe(1 + t / s["c"]), 1 / safe(1 + t * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        n = 2 * m
        even = m * (b - m) * x / ((a + n - 1) * (a + n))
        odd = -(a + m) * (a + b + m) * x / ((a + n) * (a + n + 1))
        once = F.transform(F.array(half(s, even)), lambda h: half(h, odd))  # the one-element array names the first half
        return F.get(once, F.lit(0))

    steps = F.sequence(F.lit(1.0).cast("int"), (30 + 4 * F.sqrt(F.least(a + b, F.lit(1e10)))).cast("int"))
    return F.aggregate(steps, zero, lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def _beta_tail(x: Column, n: Column, p: Column) -> Column:
    """P(X > x) as the incomplete beta function of p with x + 1 and n - x."""
    a, b = (x + 1).cast("double"), (n - x).cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(p) + b * F.log1p(-p))
    return F.when(p < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, p) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - p) / b)


def binomial_tail(x: Column, n: Column, p: Column) -> Column:
    """P(X > x) for X binomial(n, p): up to SUMMED by the recurrence of the logarithm of the mass, beyond by a continued fraction.

    0 where x >= n or p <= 0, 1 where p >= 1 (and x < n). Beyond SUMMED it is good to about 1e-6 of the result.
    """
    safe = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-300))
    start = F.struct(F.lit(0.0).alias("cdf"), (n * F.log1p(-safe)).alias("lp"))
    step = lambda a, k: F.struct(
        (a["cdf"] + F.exp(a["lp"])).alias("cdf"),
        (a["lp"] + F.log(F.greatest(n - k, F.lit(1)) / (k + 1)) + F.log(safe) - F.log1p(-safe)).alias("lp"),
    )
    cdf = F.aggregate(F.sequence(F.lit(0), F.least(F.greatest(x, F.lit(0)), F.lit(SUMMED)).cast("int")), start, step, lambda a: a["cdf"])
    tail = F.when(x <= SUMMED, F.greatest(F.lit(0.0), 1 - cdf)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _beta_tail(F.least(x, n - 1), n, safe))))
    return F.when((x >= n) | (p <= 0), 0.0).when(p >= 1, 1.0).otherwise(tail)


def chi2_tail_even(x: Column, half_df: Column) -> Column:
    """P(chi-squared > x) with 2 * half_df degrees of freedom: exp(-x/2) times a partial exponential series."""
    h = x / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    step = lambda a, k: F.struct((a["term"] * h / (k + 1)).alias("term"), (a["total"] + a["term"]).alias("total"))
    return F.exp(-h) * F.aggregate(F.sequence(F.lit(0), half_df.cast("int") - 1), start, step, lambda a: a["total"])
