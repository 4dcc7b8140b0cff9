"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of unit vectors, drawn by hash of the id: ``sample_rows``, 20,000 by default, or
16 times the root of the table's rows where that is more, up to ``most_sample_rows``, 200,000. It has about as many leaves
as the root of the rows, so leaves are many where the table is large. Every row of the table is then put in the leaf that a greedy descent reaches. A query pops tree nodes from a priority
queue by the distance of their centres and visits leaves in that order; how many is calibrated on sample queries
against brute force, widening until ``target_recall`` of the true neighbours lie in visited leaves. A query whose
visited leaves hold fewer than k + 1 vec_ids goes on until they do or all leaves are visited. Visited leaves and
queries meet by leaf: a row goes to its own leaf only, once for every ``queries_per_cell`` queries that visit it, a leaf of
any size is salted into parts, and queries stream past the part that is held.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a
null vec_id; vectors of another length than most are searched among their own kind in full; identical rows count once,
and with several vectors under one vec_id the best score counts; an empty table gives an empty result; extra columns
are ignored; ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.blocks import meet, merge_best, usable
from lattica.session import cut, table

PAIRS = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Nodes by number: a leaf has a leaf number, an inner node has children and their centres."""

    dim: int
    children: dict[int, list[int]] = field(default_factory=dict)
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    leaf: dict[int, int] = field(default_factory=dict)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector by greedy descent."""
        out = np.empty(len(x), dtype=np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
                continue
            near = np.argmax(x[rows] @ self.centres[node].T - 0.5 * (self.centres[node] ** 2).sum(axis=1), axis=1)
            stack += [(c, rows[near == i]) for i, c in enumerate(self.children[node]) if (near == i).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves in the order of a best-bin-first traversal, and more until they hold ``least`` rows by ``sizes``."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                out.append(self.leaf[node])
                held += sizes.get(self.leaf[node], 0) if sizes else 0
                continue
            far = ((self.centres[node] - q) ** 2).sum(axis=1)
            for d, c in zip(far, self.children[node]):
                heapq.heappush(queue, (float(d), c))
        return out


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        used = np.unique(near)
        centres = np.stack([x[near == i].mean(axis=0) for i in used])
    near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
    return centres, near


def fit_tree(x: np.ndarray, branching: int = 16, leaf_rows: int = 128, rounds: int = 8, seed: int = 11) -> Tree:
    """A tree over unit vectors; a node of at most ``leaf_rows``, or one that can't be parted, is a leaf.

    A node has as many children as it takes to fill leaves, ``branching`` at most, so the number of leaves follows the sample's size.
    """
    tree, rng, todo, nodes = Tree(x.shape[1]), np.random.default_rng(seed), [(0, x)], 1
    while todo:
        node, own = todo.pop()
        parts = min(branching, -(-len(own) // leaf_rows))
        centres, near = _k_means(own, parts, rounds, rng) if len(own) > leaf_rows else (np.zeros((1, x.shape[1])), np.zeros(len(own), dtype=int))
        parts = np.unique(near)
        if len(parts) < 2:
            tree.leaf[node] = len(tree.leaf)
            continue
        tree.children[node] = list(range(nodes, nodes + len(parts)))
        tree.centres[node] = centres[parts]
        nodes += len(parts)
        todo += [(c, own[near == p]) for c, p in zip(tree.children[node], parts)]
    return tree


def calibrate(tree: Tree, x: np.ndarray, k: int, target_recall: float, queries: int = 300) -> int:
    """The fewest leaf visits that cover ``target_recall`` of true neighbours; the last fifth of ``x``, which the tree hasn't seen, asks."""
    home = tree.assign(x)
    picked = np.linspace(int(0.8 * len(x)), len(x) - 1, min(queries, len(x))).astype(int)
    needed = []
    for i in picked:
        near = x @ x[i]
        near[i] = -np.inf
        true = np.argsort(-near)[: min(k, len(x) - 1)]
        order = {leaf: n + 1 for n, leaf in enumerate(tree.best_bins(x[i], len(tree.leaf)))}
        needed += [order[leaf] for leaf in home[true]]
    if not needed:
        return len(tree.leaf)
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))) - 1)])


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(query_ids, q, ids, x, k) -> pd.DataFrame:
    """Best ``k`` of a group by cosine; each kept pair is scored on its own, so equal vectors score equally."""
    rough = _unit(q) @ _unit(x).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    x_size, q_size = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    keep = min(k, len(x))
    at = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
    floor = np.take_along_axis(rough, at, axis=1).min(axis=1)
    tied = ((rough >= floor[:, None] - 1e-9).sum(axis=1) > keep) | ~np.isfinite(floor) | (len(np.unique(ids)) < len(ids))
    pairs = [(np.repeat(np.flatnonzero(~tied), keep), at[~tied].ravel())]
    for i in np.flatnonzero(tied):
        near = np.flatnonzero((rough[i] >= floor[i] - 1e-9) & np.isfinite(rough[i])) if len(np.unique(ids)) == len(ids) else np.flatnonzero(np.isfinite(rough[i]))
        pairs.append((np.full(len(near), i), near))
    who, near = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    score = np.concatenate([(x[n] * q[w]).sum(axis=1) / (x_size[n] * q_size[w]) for w, n in _slices(who, near)]) if len(who) else np.zeros(0)
    odd = ~np.isfinite(score) | (score == 0)  # under- and overflow of the squares
    score[odd] = rough[who, near][odd]
    order = np.lexsort((ids[near], -score, who))
    out = pd.DataFrame({"query_id": query_ids[who[order]], "vec_id": ids[near[order]], "score": score[order]}).drop_duplicates(["query_id", "vec_id"])
    return out[out.groupby("query_id").cumcount() < k]


def _slices(who, near, rows: int = 65_536):
    return [(who[i : i + rows], near[i : i + rows]) for i in range(0, len(who), rows)]


def nearest(
    vectors: DataFrame, query_every: int = 50, k: int = 5, target_recall: float = 0.98, sample_rows: int = 20_000, most_sample_rows: int = 200_000,
    rows_per_group: int = 20_000, queries_per_cell: int = 20_000,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` by cosine for queries whose vec_id ``query_every`` divides."""
    some = F.exists("embedding", lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable() & some)
    good = good.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dim")).distinct()
    root = math.isqrt(good.count())
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(most_sample_rows, max(sample_rows, 16 * root))).toPandas()
    if sample.empty:
        return merge_best(good.sparkSession.createDataFrame([], PAIRS), k)
    dim = int(sample["dim"].mode().iloc[0])
    x = _unit(sample.loc[sample["dim"] == dim, "v"])
    seen = x[: max(1, int(0.8 * len(x)))]
    tree = fit_tree(seen, leaf_rows=max(16, min(128, len(seen) // max(1, root))))
    visits = calibrate(tree, x, k, target_recall)

    def leaves(batches):
        for batch in batches:
            main = (batch["dim"] == dim).to_numpy()
            leaf = -batch["dim"].to_numpy(dtype=np.int64) - 1
            if main.any():
                leaf[main] = tree.assign(_unit(batch.loc[main, "v"]))
            yield batch.assign(leaf=leaf)

    placed = good.mapInPandas(leaves, "vec_id long, v array<double>, dim int, leaf long")
    first = F.min("leaf").over(Window.partitionBy("vec_id", F.col("leaf") < 0))  # over a row a leaf: a vec_id counts in one leaf only
    by_id = placed.groupBy("vec_id", "leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("own", (F.col("leaf") == first).cast("int"))
    sizes = by_id.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect()  # a row a leaf
    ids_in = {r["leaf"]: r["own"] for r in sizes}

    def visited(batches):
        for batch in batches:
            own = [tree.best_bins(_unit([v])[0], visits, ids_in, k + 1) if d == dim else [-int(d) - 1] for v, d in zip(batch["v"], batch["dim"])]
            yield batch.assign(leaf=own)

    asked = good.where(F.col("vec_id") % query_every == 0).mapInPandas(visited, "vec_id long, v array<double>, dim int, leaf array<long>")
    asked = cut(asked.withColumn("leaf", F.explode("leaf")))
    visitors = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}  # a row a leaf
    cells = [(r["leaf"], -(-r["n"] // rows_per_group), -(-visitors.get(r["leaf"], 0) // queries_per_cell)) for r in sizes]
    cells = F.broadcast(good.sparkSession.createDataFrame(cells, "leaf long, salts long, blocks long"))
    none = F.lit(None).cast("double").alias("floor")
    rows = placed.join(cells.where("blocks > 0"), "leaf")  # leaves that no query visits stay where they are
    rows = rows.select("leaf", F.pmod(F.xxhash64("vec_id"), "salts").alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), "vec_id", "v", none)
    queries = asked.join(cells, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("vec_id"), "blocks").alias("b"), "vec_id", "v", none)
    found = meet(rows, queries, ["leaf", "salt", "b"], lambda ids, x, query_ids, q, _: _best(query_ids, q, ids, x, k), PAIRS)
    return merge_best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's five nearest rows."""
    return nearest(table(spark, sf_dir, "embeddings"))
