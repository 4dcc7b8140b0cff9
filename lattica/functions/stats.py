"""Statistics on columns and arrays, and false discovery rates over tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.special import chi_square_tail, gamma_q, normal_two_tailed, t_two_tailed
from lattica.operators.ranking import running_sums


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of one length; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)).cast("double")


def network_distance(a: Column, b: Column, sizes: Column) -> Column:
    """Share of members that sit in clusters on which the two vectors differ."""
    differs = F.zip_with(F.zip_with(a, b, lambda x, y: x != y), sizes, lambda d, n: F.when(d, n).otherwise(0))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.aggregate(differs, F.lit(0).cast("long"), lambda s, x: s + x) / total


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient: shared members over the smaller set's size."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def log2(x: Column, mode: str = "standard") -> Column:
    """Base 2; ``mode='reference'`` gives the natural logarithm, as the replaced library does."""
    return F.log2(x) if mode == "standard" else F.ln(x)


def two_proportion_z(success1: Column, n1: Column, success2: Column, n2: Column) -> Column:
    """Pooled z of two shares."""
    pooled = (success1 + success2) / (n1 + n2)
    return (success1 / n1 - success2 / n2) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))


def one_proportion_z(share: Column, expected: Column, n: Column) -> Column:
    return (share - expected) / F.sqrt(expected * (1 - expected) / n)


def one_proportion_p(share: Column, expected: Column, n: Column) -> Column:
    return normal_two_tailed(one_proportion_z(share, expected, n))


def proportion_chi_square(success: Column, n: Column, expected: Column) -> Column:
    """Chi-square statistic of a share with Yates' correction."""
    off = F.greatest(F.abs(success - n * expected) - 0.5, F.lit(0.0))
    return off * off / (n * expected) + off * off / (n * (1 - expected))


def proportion_test(success: Column, n: Column, expected: Column) -> Column:
    return chi_square_tail(1.0, proportion_chi_square(success, n, expected))


def enrichment_ratio(ratio: Column, n: Column, success: Column) -> Column:
    return (success / n) / ratio


def fisher_statistic(log_sum: Column) -> Column:
    return -2.0 * log_sum


def combine_p_values(table: DataFrame, group: str, p: str) -> DataFrame:
    """Fisher's method by group: ``(group, k, statistic, combined)``; a p-value of 0 makes the group's result null."""
    s = table.groupBy(group).agg(F.count(p).alias("k"), F.sum(F.ln(p)).alias("l"), F.min(p).alias("low"))
    stat = F.when(F.col("low") > 0, -2.0 * F.col("l"))
    return s.select(group, "k", stat.alias("statistic"), gamma_q(F.col("k").cast("double"), stat / 2.0).alias("combined"))


def dependent_p_values(values: DataFrame, p_values: DataFrame, mode: str = "standard") -> DataFrame:
    """One p for dependent tests by a scaled chi-square: ``values(series, sample, value)``, ``p_values(series, p)``.

    The covariance of two tests is a fixed polynomial in their correlation. ``mode='reference'`` multiplies the statistic
    by the scale, as the replaced library does; the published method divides.
    """
    pairs = values.alias("x").join(values.alias("y"), (F.col("x.sample") == F.col("y.sample")) & (F.col("x.series") < F.col("y.series")))
    rho = pairs.groupBy(F.col("x.series").alias("a"), F.col("y.series").alias("b")).agg(F.corr("x.value", "y.value").alias("rho"))
    cov = rho.agg(F.coalesce(F.sum(F.col("rho") * (3.263 + F.col("rho") * (0.710 + 0.027 * F.col("rho")))), F.lit(0.0)).alias("cov"))
    s = p_values.agg(F.count("p").alias("k"), F.sum(-2.0 * F.ln(F.greatest("p", F.lit(1e-16)))).alias("x"))
    both = s.crossJoin(cov).withColumn("mean", 2.0 * F.col("k")).withColumn("var", 4.0 * F.col("k") + 2.0 * F.col("cov"))
    df, scale = 2.0 * F.col("mean") * F.col("mean") / F.col("var"), F.col("var") / (2.0 * F.col("mean"))
    x = F.col("x") / scale if mode == "standard" else F.col("x") * scale
    return both.select("k", F.col("x").alias("statistic"), df.alias("df"), scale.alias("scale"), gamma_q(df / 2.0, x / 2.0).alias("combined"))


def benjamini_hochberg(table: DataFrame, p: str, by: list[str] | None = None, mode: str = "standard", tie: str | None = None) -> DataFrame:
    """Adds ``rank`` and ``fdr``: the running minimum from the largest p down of p * n / rank.

    ``mode='reference'`` takes n / rank as a whole number. ``by`` keeps families apart; a family is ranked in one
    window, so it should be a list of terms, not of rows.
    """
    keys = by or []
    order = [F.col(p), *([F.col(tie)] if tie else [])]
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    factor = F.col("_n") / F.col("rank") if mode == "standard" else F.floor(F.col("_n") / F.col("rank"))
    down = Window.partitionBy(*keys).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("fdr", F.min(F.col(p) * factor).over(down)).drop("_n")


def empirical_fdr(real: DataFrame, random: DataFrame, value: str) -> DataFrame:
    """Adds ``fdr`` to each real value: share of random values at least as large over share of real ones, at most 1.

    Both counts come from one sorted cumulative sum over distinct values, not from pairs.
    """
    both = real.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(random.select(F.col(value), F.lit(0), F.lit(1)))
    hist = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    cum = running_sums(hist, [], [F.desc("v")], ca="a", cb="b").crossJoin(F.broadcast(n))
    rate = cum.select(F.col("v").alias(value), F.least(F.lit(1.0), (F.col("cb") / F.col("nb")) / (F.col("ca") / F.col("na"))).alias("fdr"))
    return real.join(rate, value)


def welch(table: DataFrame, by: list[str], sample: Column, value: str) -> DataFrame:
    """Two-sample t of unequal variance by group: ``sample`` is true for the first sample, false for the second."""
    v = F.col(value).cast("double")
    one, two = F.when(sample, v), F.when(~sample, v)
    s = table.groupBy(*by).agg(*[f(x).alias(f"{n}{i}") for i, x in ((1, one), (2, two)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    e1, e2 = F.try_divide("var1", "n1"), F.try_divide("var2", "n2")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2))
    df = F.try_divide(F.pow(e1 + e2, 2), e1 * e1 / F.nullif(F.col("n1") - 1, F.lit(0)) + e2 * e2 / F.nullif(F.col("n2") - 1, F.lit(0)))
    out = s.where("n1 > 1 and n2 > 1").where(e1 + e2 > 0).select(*by, "n1", "n2", t.alias("t"), df.alias("df"))
    return out.withColumn("p", t_two_tailed(F.col("t"), F.col("df")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient as an aggregate; 1 where a side does not vary."""
    flat = (F.var_pop(x) == 0) | (F.var_pop(y) == 0)
    return F.when(flat, 1.0).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def number_of_bins(n: Column) -> Column:
    return (F.floor(F.ln(n) / math.log(2)) + 1).cast("int")
