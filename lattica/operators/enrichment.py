"""Gene-set enrichment over long annotation tables ``(key, term)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.special import binomial_tail, hypergeometric_tail
from lattica.functions.stats import benjamini_hochberg


def term_sizes(annotation: DataFrame) -> DataFrame:
    """``(term, n, ratio)``: keys a term has, and their share of all annotated keys."""
    a = annotation.select("key", "term").distinct()
    total = a.agg(F.countDistinct("key").alias("total"))
    return a.groupBy("term").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("term", "n", (F.col("n") / F.col("total")).alias("ratio"))


def hits(query: DataFrame, annotation: DataFrame) -> DataFrame:
    """``(term, hits, touched)``: query keys with the term, and query keys with any; a key asked for twice counts twice."""
    a = annotation.select("key", "term").distinct()
    touched = query.join(a.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("touched"))
    return query.join(a, "key").groupBy("term").agg(F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(touched))


def enrich(query: DataFrame, annotation: DataFrame, mode: str = "standard") -> DataFrame:
    """Binomial upper tails of all terms that the query hits, with Benjamini-Hochberg rates."""
    found = hits(query, annotation).join(term_sizes(annotation), "term")
    found = found.withColumn("p_value", binomial_tail(F.col("ratio"), F.col("touched"), F.col("hits")))
    return benjamini_hochberg(found, "p_value", mode=mode, tie="term").drop("rank")


def permutation_fdr(query: DataFrame, annotation: DataFrame, background: DataFrame, permutations: int = 100, seed: str = "p") -> DataFrame:
    """``(term, p_value, fdr)``: share of random p-values at most as large over the share of real ones, at most 1.

    Each permutation draws as many keys as the query has from the background, by hash; all permutations run as one job.
    """
    n = query.select("key").distinct().count()
    drawn = sample_by_hash(background.select("key").distinct(), "key", n, permutations, seed)
    a = annotation.select("key", "term").distinct()
    sizes = term_sizes(annotation)
    random = drawn.join(a, "key").groupBy("perm", "term").agg(F.count(F.lit(1)).alias("hits"))
    touched = drawn.join(a.select("key").distinct(), "key", "left_semi").groupBy("perm").agg(F.count(F.lit(1)).alias("touched"))
    random = random.join(touched, "perm").join(sizes, "term").select(F.round(binomial_tail(F.col("ratio"), F.col("touched"), F.col("hits")), 12).alias("p_value"))
    real = enrich(query, annotation).select("term", F.round("p_value", 12).alias("p_value"))
    tagged = real.select("p_value", F.lit(1).alias("r"), F.lit(0).alias("q")).union(random.select("p_value", F.lit(0), F.lit(1)))
    at_most = Window.orderBy("p_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = tagged.groupBy("p_value").agg(F.sum("r").alias("r"), F.sum("q").alias("q")).select("p_value", F.sum("r").over(at_most).alias("r"), F.sum("q").over(at_most).alias("q"))
    return real.join(cum, "p_value").select("term", "p_value", F.least(F.lit(1.0), F.col("q") / permutations / F.col("r")).alias("fdr"))


def sample_by_hash(keys: DataFrame, key: str, n: int, draws: int = 1, seed: str = "s") -> DataFrame:
    """``(perm, key)``: for each draw the ``n`` keys whose md5 of draw and key is smallest; the same on every run."""
    each = keys.select(F.col(key).alias("key")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    each = each.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "perm", "key")))
    near = each.withColumn("part", F.substring("h", 1, 1))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("perm", "part").orderBy("h", "key"))).where(F.col("r") <= n)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("perm").orderBy("h", "key"))).where(F.col("r") <= n).select("perm", "key")


def cluster_terms(clusters: DataFrame, annotation: DataFrame, least_size: int = 3, cut: float = 0.01) -> DataFrame:
    """Hypergeometric tails of every cluster and every term it holds; the universe is all annotated members of clusters."""
    a = annotation.select(F.col("key").alias("node"), "term").distinct()
    c = clusters.select("node", "cluster").distinct()
    known = c.join(a.select("node").distinct(), "node", "left_semi")
    total = known.agg(F.countDistinct("node").alias("total"))
    sizes = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_size)
    marked = a.join(known.select("node").distinct(), "node", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("in_term"))
    both = known.join(a, "node").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("hits"))
    out = both.join(sizes, "cluster").join(marked, "term").crossJoin(F.broadcast(total))
    out = out.withColumn("p_value", hypergeometric_tail(F.col("total"), F.col("in_term"), F.col("size"), F.col("hits")))
    return out.where(F.col("p_value") <= cut).select("cluster", "term", "size", "in_term", "hits", "p_value")


def topics_of_path(path_edges: DataFrame, edge_topics: DataFrame) -> DataFrame:
    """``(source, node, topics)``: all topics of the edges along each path."""
    return path_edges.join(edge_topics, ["src", "dst"]).groupBy("source", "node").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
