"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments; the mean and deviation of each bound the inner product of two vectors from above,
``sum of m * (mean * mean + dev * dev)`` over segments of m components (the same statistics give the lower-bound
distance ``sum of m * ((mean - mean)^2 + (dev - dev)^2)``, and ``2xy = |x|^2 + |y|^2 - distance``). Bounds are taken
with 4 segments for all pairs, with 8 for those that are left, with 16 for those left then; what may still reach the
k-th best score is scored exactly in integers, so the result is exact.

A first group of rows gives every query a floor, its k-th best score there, with which it goes to the other groups. A
group of rows is held by a task and queries stream past it.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors of another length than the query's are no candidates; a repeated row is one candidate, and with
several vectors under one vec_id the best score counts; an empty table gives an empty result; extra columns are
ignored. Components are floored to integers; their products must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.blocks import meet, merge_best, usable
from lattica.session import cut, table

LEVELS = (4, 8, 16)
SCALE = 1024


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, means and deviations of about equal segments of each row."""
    edges = np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).astype(int)
    size = np.diff(edges).astype(float)
    if x.shape[1] == 0:
        return np.ones(1), np.zeros((len(x), 1)), np.zeros((len(x), 1))
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return size, mean, np.sqrt(np.maximum(square - mean**2, 0))


def slack(bound: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``bound`` and what rounding may have taken from it; ``sizes`` are products of the vectors' lengths."""
    return bound + np.where(np.isfinite(bound), 1e-6 * (1 + np.abs(bound)), 0) + 1e-9 * sizes


class Levels:
    """Segment statistics of a group of vectors at every level, coarse to fine, each a row of weighted means and deviations."""

    def __init__(self, x: np.ndarray):
        self.length = np.sqrt((x * x).sum(axis=1))
        self.rows = []
        for segments in LEVELS:
            size, mean, deviation = segment_statistics(x, segments)
            self.rows.append(np.concatenate([mean * np.sqrt(size), deviation * np.sqrt(size)], axis=1))

    def bounds(self, level: int, other: Levels, alive: np.ndarray) -> np.ndarray:
        """Bounds of one level for the pairs that are alive, minus infinity for the others."""
        bound = _for_alive(self.rows[level], other.rows[level], alive)
        return slack(bound, self.length[:, None] * other.length[None, :])


def _for_alive(own: np.ndarray, their: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Products of the rows of either side for the pairs that are alive: one by one if they are few, all at once if they are many."""
    if np.count_nonzero(alive) > alive.size / 16:
        return np.where(alive, own @ their.T, -np.inf)
    out = np.full(alive.shape, -np.inf)
    for i, j in _slices(*np.nonzero(alive)):
        out[i, j] = np.einsum("pd,pd->p", own[i], their[j])
    return out


def _slices(i: np.ndarray, j: np.ndarray, rows: int = 65_536):
    return [(i[a : a + rows], j[a : a + rows]) for a in range(0, len(i), rows)]


def upper_bounds(q: np.ndarray, x: np.ndarray, level: int) -> np.ndarray:
    """For every query and row a number that their inner product can't exceed, rounding included."""
    return Levels(q).bounds(level, Levels(x), np.ones((len(q), len(x)), dtype=bool))


def block_top_k(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int, levels: Levels | None = None, counts: dict | None = None) -> pd.DataFrame:
    """Exact best ``k`` of the block for each query, but for those under the query's floor; ``counts`` takes how many pairs each level saw.

    Every level looks only at the pairs that the one before has left.
    """
    qf, xf = q.astype(float), x.astype(float)
    exact = np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0) * max(q.shape[1], 1) < 2**53
    of_q, of_x = Levels(qf), levels or Levels(xf)
    alive = query_ids[:, None] != ids[None, :]
    tally = [alive.size]
    floor = np.nan_to_num(floors.astype(float), nan=-np.inf)
    single = len(np.unique(ids)) == len(ids)
    for level in range(len(LEVELS)):
        bound = of_q.bounds(level, of_x, alive)
        if len(x) > k and single:  # the exact scores of each query's k pairs of highest bound may raise its floor
            near = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            seen = np.einsum("qkd,qd->qk", xf[near], qf)
            seen[~np.take_along_axis(alive, near, axis=1)] = -np.inf
            worst = seen.min(axis=1)
            floor = np.maximum(floor, worst - 1e-6 * (1 + np.abs(np.where(np.isfinite(worst), worst, 0))))
        alive = alive & (bound >= floor[:, None])
        tally.append(int(alive.sum()))
    if counts is not None:
        for name, n in zip(("pairs", *LEVELS), tally):
            counts[name] = counts.get(name, 0) + n
    i, j = np.nonzero(alive)
    if exact:
        product = _for_alive(qf, xf, alive)
        if len(x) > k and single:  # what is under the k-th best goes before anything is sorted
            least = -np.partition(-product, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero(alive & (product >= least[:, None] - 0.5))
        score = np.rint(product[i, j]).astype(np.int64)
    else:
        score = np.concatenate([np.einsum("pd,pd->p", q[a], x[b]) for a, b in _slices(i, j)]) if len(i) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((ids[j], -score, i))
    found = pd.DataFrame({"query_id": query_ids[i[order]], "vec_id": ids[j[order]], "score": score[order]})
    if not single:
        found = found.drop_duplicates(["query_id", "vec_id"])
    return found[found.groupby("query_id").cumcount() < k]


def exact_top_k(vectors: DataFrame, query_every: int = 100, k: int = 10, rows_per_group: int = 20_000, queries_per_cell: int = 100_000) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for queries whose vec_id ``query_every`` divides, against every row but their own."""
    good = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    good = good.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"), F.size("embedding").alias("dim")).distinct()
    asked = good.where(F.col("vec_id") % query_every == 0)
    counts = good.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % query_every == 0, 1)).alias("q")).first()
    groups = max(8, -(-counts["n"] // rows_per_group))
    blocks = max(1, -(-counts["q"] // queries_per_cell))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("long").alias("floor")
    keys, schema = ["dim", "g", "b"], "query_id long, vec_id long, score long"
    best = lambda ids, x, query_ids, q, floors: block_top_k(ids, x, query_ids, q, floors, k)
    dealt = good.withColumn("g", deal(groups))
    queries = asked.withColumn("b", deal(blocks))

    # The first group of rows gives every query a floor: its k-th best score there.
    pilot = meet(dealt.where("g = 0").select("dim", "g", every(blocks).alias("b"), "vec_id", "v", none), queries.select("dim", F.lit(0).alias("g"), "b", "vec_id", "v", none), keys, best, schema, np.int64, 256)
    pilot = cut(pilot.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    floors = merge_best(pilot, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = queries.join(floors, "vec_id", "left").select("dim", F.explode(F.sequence(F.lit(1), F.lit(groups - 1))).alias("g"), "b", "vec_id", "v", "floor")
    found = meet(dealt.where("g > 0").select("dim", "g", every(blocks).alias("b"), "vec_id", "v", none), rest, keys, best, schema, np.int64, 256)
    return merge_best(found.union(pilot).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's ten highest integer inner products."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) x WHERE rank <= 10
"""
