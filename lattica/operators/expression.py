"""Expression matrices in long form ``(feature, sample, value)``: transforms, selections, correlations and information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.stats import correlation, number_of_bins
from lattica.operators.ranking import running_sums


def log_transform(m: DataFrame) -> DataFrame:
    """Natural logarithm of the cells; cells that are null or not above 0 become null."""
    return m.withColumn("value", F.when(F.col("value") > 0, F.ln("value")))


def _by_group(m: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """Per-group numbers joined back: a map-side combined aggregate, so that a group of any size is no task of its own."""
    return m.join(m.groupBy(by).agg(*aggregates), by)


def z_score_by_sample(m: DataFrame) -> DataFrame:
    g = _by_group(m, "sample", F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return g.select("feature", "sample", ((F.col("value") - F.col("_m")) / F.when(F.col("_s") != 0, F.col("_s"))).alias("value"))


def z_score(m: DataFrame) -> DataFrame:
    s = m.agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return m.crossJoin(F.broadcast(s)).select("feature", "sample", F.try_divide(F.col("value") - F.col("_m"), F.col("_s")).alias("value"))


def rank_by_sample(m: DataFrame) -> DataFrame:
    """Place by falling value over the number of cells; equal values share the first place."""
    counts = m.where("value is not null").groupBy("sample", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("sample").agg(F.sum("n").alias("cells"))
    place = running_sums(counts, ["sample"], [F.desc("value")], upto="n").join(whole, "sample")
    place = place.select("sample", "value", ((F.col("upto") - F.col("n") + 1) / F.col("cells")).alias("rank"))
    return m.where("value is not null").join(place, ["sample", "value"]).select("feature", "sample", F.col("rank").alias("value"))


def centre_by_feature(m: DataFrame, mode: str = "standard") -> DataFrame:
    """Value minus the feature's median; ``mode='reference'`` takes the half-percent point, the least value of short rows."""
    middle = F.median("value") if mode == "standard" else F.min("value")
    g = _by_group(m, "feature", middle.alias("_c"))
    return g.select("feature", "sample", (F.col("value") - F.col("_c")).alias("value"))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both; samples must be the same on either side."""
    differ = first.select("sample").distinct().exceptAll(second.select("sample").distinct()).union(second.select("sample").distinct().exceptAll(first.select("sample").distinct()))
    if not differ.isEmpty():
        raise ValueError("the matrices have different samples")
    return first.select("feature", "sample", "value").union(second.select("feature", "sample", "value"))


def select_features(m: DataFrame, features: list) -> DataFrame:
    """Features in the given order as ``position``; one that is missing is an error."""
    wanted = m.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], f"feature {dict(m.dtypes)['feature']}, position int")
    missing = wanted.join(m.select("feature").distinct(), "feature", "left_anti").select("feature").limit(5).collect()
    if missing:
        raise KeyError(f"no such feature: {[r['feature'] for r in missing]}")
    return m.join(F.broadcast(wanted), "feature")


def to_wide(m: DataFrame, samples: list | None = None) -> DataFrame:
    return m.groupBy("feature").pivot("sample", samples).agg(F.first("value"))


def to_long(wide: DataFrame, feature: str = "feature") -> DataFrame:
    samples = [c for c in wide.columns if c != feature]
    return wide.unpivot(feature, samples, "sample", "value").withColumnRenamed(feature, "feature").where("value is not null")


def edge_correlation(m: DataFrame, edges: DataFrame, absolute: bool = False, exclude: str | None = None) -> DataFrame:
    """``(src, dst, n, correlation)`` over samples that both ends have; samples whose name holds ``exclude`` are left out."""
    own = m.where("value is not null")
    if exclude is not None:
        own = own.where(~F.col("sample").cast("string").contains(exclude))
    a = own.select(F.col("feature").alias("src"), "sample", F.col("value").alias("x"))
    b = own.select(F.col("feature").alias("dst"), "sample", F.col("value").alias("y"))
    c = correlation(F.col("x"), F.col("y"))
    both = edges.join(a, "src").join(b, ["dst", "sample"]).groupBy("src", "dst")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.abs(c) if absolute else c).alias("correlation"))


def spearman(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's coefficient by group: Pearson's on mean ranks, which come from the counts of distinct values. Pairs with a null are left out."""

    own = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def mean_rank(c, name):
        counts = own.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        return running_sums(counts, by, [F.col(c)], _upto="_n").select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))

    ranked = own.join(mean_rank(x, "rx"), [*by, x]).join(mean_rank(y, "ry"), [*by, y])
    return ranked.groupBy(*by).agg(correlation(F.col("rx"), F.col("ry")).alias("spearman"))


def average_over(m: DataFrame, sets: DataFrame) -> DataFrame:
    """``(set, sample, value)``: mean of the cells of each set of ``sets(set, feature)``, nulls left out."""
    return m.join(sets, "feature").groupBy("set", "sample").agg(F.avg("value").alias("value")).where("value is not null")


def discretise(m: DataFrame, by: str = "feature") -> DataFrame:
    """Adds ``bin``: floor(log2 n) + 1 bins of equal width over two deviations each way; what lies above is in the last."""
    own = m.where("value is not null")
    g = _by_group(own, by, F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    bins = number_of_bins(F.col("_n"))
    raw = F.floor(F.try_divide(F.col("value") - F.col("_m") + 2 * F.col("_s"), 4 * F.col("_s") / bins)).cast("int")
    last = bins - 1
    return g.withColumn("bin", F.when(F.col("_s") == 0, last).otherwise(F.least(F.greatest(raw, F.lit(0)), last))).drop("_m", "_s", "_n")


def mutual_information(m: DataFrame, phenotype: DataFrame, by: str = "feature") -> DataFrame:
    """``(by, score)``: mutual information, natural logarithm, of discretised values with ``phenotype(sample, type)``."""
    cells = discretise(m, by).join(phenotype, "sample").groupBy(by, "bin", "type").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(by)
    share = cells.select(by, F.col("n"), F.sum("n").over(own).alias("t"), F.sum("n").over(Window.partitionBy(by, "bin")).alias("nb"), F.sum("n").over(Window.partitionBy(by, "type")).alias("nt"))
    return share.groupBy(by).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("nt")))).alias("score"))
