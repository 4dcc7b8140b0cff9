"""Special functions and statistical tails as column expressions, all inside the JVM.

Continued fractions, series and tails run as many steps as double precision takes for the row's own arguments: a number that
grows with the square root of the mean or of the degrees of freedom, not with the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
STEPS = 300


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def log_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x >= 0.5."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def log_factorial(n: Column) -> Column:
    return log_gamma(n.cast("double") + 1.0)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _tail(first: Column, last: Column, mean: Column, log_term, log_ratio) -> Column:
    """Sum of terms ``first..last`` from the log of a term and the log ratio of each to the one before.

    Only terms near ``mean`` or ``first`` are taken. Of binomial and hypergeometric terms, the ones ``d`` beyond both fall to
    under exp(-d * d / (2 * (mean + d / 3))) of the nearer; ``d`` is where that is exp(-50), so what is left out, above as below, does
    not show in a double.
    """
    d = F.sqrt(100.0 * mean + 2500.0 / 9) + 50.0 / 3
    low = F.greatest(first.cast("double"), F.floor(mean - d)).cast("int")
    high = F.least(last.cast("double"), F.ceil(F.greatest(first.cast("double"), mean) + d)).cast("int")
    start = F.struct(F.lit(0.0).alias("sum"), log_term(low).alias("log"))

    def step(acc, i):
        return F.struct((acc["sum"] + F.exp(acc["log"])).alias("sum"), (acc["log"] + F.when(i < last, log_ratio(i)).otherwise(0.0)).alias("log"))

    return F.when(first > last, 0.0).otherwise(F.aggregate(F.sequence(low, F.greatest(low, high)), start, step)["sum"])


def binomial_tail(ratio: Column, n: Column, k: Column) -> Column:
    """P(X >= k) of n draws with chance ``ratio``; no success asked for counts as one. A ratio of 1 gives 1, of 0 gives 0."""
    k = F.greatest(k.cast("int"), F.lit(1))
    n = n.cast("int")
    term = lambda i: log_choose(n, i) + i * F.ln(ratio) + (n - i) * F.ln(1.0 - ratio)
    odds = F.ln(ratio) - F.ln(1.0 - ratio)
    tail = _tail(k, n, n * ratio, term, lambda i: F.ln((n - i) / (i + 1.0)) + odds)
    return F.when(n < k, 0.0).when(ratio >= 1.0, 1.0).when(ratio <= 0.0, 0.0).otherwise(F.least(tail, F.lit(1.0)))


def hypergeometric_log_point(total: Column, marked: Column, drawn: Column, k: Column) -> Column:
    return log_choose(marked, k) + log_choose(total - marked, drawn - k) - log_choose(total, drawn)


def hypergeometric_tail(total: Column, marked: Column, drawn: Column, k: Column) -> Column:
    """P(X >= k) of ``drawn`` out of ``total``, ``marked`` of them marked; 1 where more are drawn or marked than there are, as that tells nothing."""
    total, marked, drawn = (c.cast("int") for c in (total, marked, drawn))
    low = F.greatest(k.cast("int"), F.lit(0), drawn + marked - total)
    high = F.least(marked, drawn)
    mean = marked.cast("double") * drawn / F.greatest(total, F.lit(1))
    tail = _tail(low, high, mean, lambda i: hypergeometric_log_point(total, marked, drawn, i), lambda i: F.ln((marked - i) / (i + 1.0)) + F.ln((drawn - i) / (total - marked - drawn + i + 1.0)))
    return F.when((marked > total) | (drawn > total), 1.0).otherwise(F.least(tail, F.lit(1.0)))


def fisher_point(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Probability of one 2x2 table given its margins."""
    return F.exp(hypergeometric_log_point(a + b + c + d, a + c, a + b, a))


def fisher_right(a: Column, b: Column, c: Column, d: Column) -> Column:
    return hypergeometric_tail(a + b + c + d, a + c, a + b, a)


def fisher_left(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(X <= a): the right tail of the table with its columns swapped."""
    return hypergeometric_tail(a + b + c + d, b + d, a + b, b)


def fisher_cumulative(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The tail on the side that the table leans to."""
    return F.when(a * d >= b * c, fisher_right(a, b, c, d)).otherwise(fisher_left(a, b, c, d))


def fisher_two_tailed(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sum over all tables of these margins that are no likelier than the given one."""
    total, marked, drawn = a + b + c + d, a + c, a + b
    seen = hypergeometric_log_point(total, marked, drawn, a) + 1e-9
    tables = F.sequence(F.greatest(F.lit(0), drawn + marked - total).cast("int"), F.least(marked, drawn).cast("int"))
    logs = F.transform(tables, lambda i: hypergeometric_log_point(total, marked, drawn, i))
    return F.least(F.aggregate(F.filter(logs, lambda x: x <= seen), F.lit(0.0), lambda s, x: s + F.exp(x)), F.lit(1.0))


def _lower_series(a: Column, x: Column) -> Column:
    """The series of the lower incomplete gamma, for x < a + 1; its terms fall like those of ``_tail``."""
    steps = F.ceil(F.sqrt(80.0 * (a + 1.0) + 1600.0 / 9) + 40.0 / 3).cast("int")
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")), lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"), (acc["s"] + acc["t"] * x / (a + n)).alias("s")))["s"]


def _upper_fraction(a: Column, x: Column) -> Column:
    """The continued fraction of the upper incomplete gamma, for x >= a + 1.

    It settles fast where x is large, and in about 1.8 * sqrt(a) steps where x is near a (170 at a = 10,000).
    """
    steps = F.ceil(20.0 + 60.0 / x + 2.5 * F.sqrt(a)).cast("int")
    b0 = x + 1.0 - a
    start = F.struct(F.lit(1e300).alias("c"), (1.0 / b0).alias("d"), (1.0 / b0).alias("h"))

    def step(acc, i):
        an, b = -i * (i - a), b0 + 2.0 * i
        d, c = 1.0 / (an * acc["d"] + b), b + an / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["h"]


def _upper(a, x: Column) -> Column:
    """The regularised upper incomplete gamma for x >= a + 1: a finite sum for a small whole number ``a``, else the fraction."""
    if not isinstance(a, Column) and float(a).is_integer() and 1 <= a <= 20:
        total = term = F.lit(1.0)
        for i in range(1, int(a)):
            term = term * x / float(i)
            total = total + term
        return F.exp(-x) * total
    a = _c(a)
    return F.exp(a * F.ln(x) - x - log_gamma(a)) * _upper_fraction(a, x)


def _lower(a, x: Column) -> Column:
    a = _c(a)
    return F.exp(a * F.ln(x) - x - log_gamma(a)) * _lower_series(a, x)


def gamma_p(a, x: Column) -> Column:
    """Regularised lower incomplete gamma: a series below a + 1, one minus the upper one above."""
    x = x.cast("double")
    return F.when(x <= 0, 0.0).when(x < _c(a) + 1.0, _lower(a, x)).otherwise(1.0 - _upper(a, x))


def gamma_q(a, x: Column) -> Column:
    """Regularised upper incomplete gamma, precise in the far tail too."""
    x = x.cast("double")
    return F.when(x <= 0, 1.0).when(x < _c(a) + 1.0, 1.0 - _lower(a, x)).otherwise(_upper(a, x))


def chi_square_cdf(df, x: Column) -> Column:
    return gamma_p(df / 2.0, x / 2.0)


def chi_square_tail(df, x: Column) -> Column:
    return gamma_q(df / 2.0, x / 2.0)


def normal_cdf(z: Column) -> Column:
    half = gamma_q(0.5, z * z / 2.0) / 2.0
    return F.when(z < 0, half).otherwise(1.0 - half)


def normal_two_tailed(z: Column) -> Column:
    return gamma_q(0.5, z * z / 2.0)


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta by a continued fraction."""

    def fraction(a, b, x):
        d0 = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(acc, m):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1.0 / (1.0 + even * acc["d"]), 1.0 + even / acc["c"]
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d2, c2 = 1.0 / (1.0 + odd * d), 1.0 + odd / c
            return F.struct(c2.alias("c"), d2.alias("d"), (acc["h"] * d * c * d2 * c2).alias("h"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS // 2)), start, step)["h"] / a

    lead = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1.0 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1.0) / (a + b + 2.0), lead * fraction(a, b, x)).otherwise(1.0 - lead * fraction(b, a, 1.0 - x))


def t_two_tailed(t: Column, df: Column) -> Column:
    return beta_i(df / 2.0, F.lit(0.5), df / (df + t * t))
