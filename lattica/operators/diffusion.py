"""Diffusion on networks: approximate personalised PageRank, sweep cuts, heat kernels and score-weighted modules."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import connected_components, dealt_by_component
from lattica.operators.network import degrees, symmetric
from lattica.operators.ranking import numbered, running_sums
from lattica.session import cut, settled

#: Components of at most so many edges that some permutation may keep are permuted inside tasks; larger ones by joins.
MOST_LINKS = 2_000_000
#: A task works on so many permutations.
PERMUTATIONS_A_TASK = 50


def approximate_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, epsilon: float = 1e-4, most_links: int = 50_000_000) -> DataFrame:
    """``(seed, node, p, residue)`` by pushes: as long as a node's residue per edge is ``epsilon`` or more, it is pushed.

    A push moves alpha of the residue to p, keeps half of the rest and spreads the other half over the neighbours. Each push
    takes at least alpha * epsilon for every edge of its node from a residue that starts at 1, so a seed never touches more
    than 1 / (alpha * epsilon) links, whatever the network's size. A seed's pushes run inside one task, on the links that it
    has; when only nodes are left to push whose links it has not, one join fetches those for all seeds. So jobs are as many
    as the reach of the pushes in steps, not as many as rounds of pushes. A seed of more than ``most_links`` links is an error.
    """
    if not (0 < alpha < 1 and epsilon > 0):
        raise ValueError("alpha lies in (0, 1), epsilon is above 0")
    deg = settled(degrees(edges))
    near = deg.select(F.col("node").alias("neighbour"), F.col("degree").alias("neighbour_degree"))
    both = settled(symmetric(edges).join(near, "neighbour"))
    start = seeds.select(F.col("node").alias("seed")).distinct().join(deg.withColumnRenamed("node", "seed"), "seed")
    state = settled(start.select("seed", F.col("seed").alias("node"), "degree", F.lit(0.0).alias("p"), F.lit(1.0).alias("r"), F.lit(True).alias("wanted")))
    links: list[DataFrame] = []
    seed, node = dict(state.dtypes)["seed"], dict(state.dtypes)["node"]

    def push(now: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(own) > most_links:
            raise RuntimeError(f"a seed touches more than {most_links} links")
        ids = pd.Index(pd.concat([now["node"], own["neighbour"]]).unique())
        n = len(ids)
        degree, p, r, known = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
        a, b = ids.get_indexer(own["node"]), ids.get_indexer(own["neighbour"])
        degree[b] = own["neighbour_degree"]
        at = ids.get_indexer(now["node"])
        degree[at], p[at], r[at] = now["degree"], now["p"], now["r"]
        known[a] = True
        while (active := known & (r >= epsilon * degree)).any():
            moved = np.where(active, r, 0.0)
            p += alpha * moved
            r += np.bincount(b, weights=((1 - alpha) / 2 * moved / degree)[a], minlength=n) - (1 + alpha) / 2 * moved
        met = (p > 0) | (r > 0)
        out = pd.DataFrame({"node": ids, "degree": degree.astype(np.int64), "p": p, "r": r, "wanted": ~known & (r >= epsilon * degree)})[met]
        return out.assign(seed=now["seed"].iloc[0])[["seed", "node", "degree", "p", "r", "wanted"]]

    while True:
        wanted = state.where("wanted").select("seed", "node")
        if wanted.isEmpty():
            return state.select("seed", "node", "p", F.col("r").alias("residue"))
        links.append(settled(wanted.join(both, "node").select("seed", "node", "neighbour", "neighbour_degree")))
        own = reduce(DataFrame.union, links)
        pushed = state.groupBy("seed").cogroup(own.groupBy("seed")).applyInPandas(push, f"seed {seed}, node {node}, degree long, p double, r double, wanted boolean")
        state = settled(pushed, state)


def pagerank_with_priors(edges: DataFrame, seeds: DataFrame, back: float, rounds: int = 30) -> DataFrame:
    """``(seed, node, rank)`` by power iteration; each step returns to the seed with chance ``back``."""
    both = cut(symmetric(edges).join(degrees(edges), "node"))
    home = cut(seeds.select(F.col("node").alias("seed"), "node").join(both.select("node").distinct(), "node", "left_semi").select("seed", "node", F.lit(1.0).alias("rank")))
    rank = home
    for _ in range(rounds):
        moved = rank.join(both, "node").select("seed", F.col("neighbour").alias("node"), (F.col("rank") * (1 - back) / F.col("degree")).alias("rank"))
        rank = cut(moved.union(home.withColumn("rank", F.col("rank") * back)).groupBy("seed", "node").agg(F.sum("rank").alias("rank")))
    return rank


def sweep(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(seed, position, node, volume, boundary, conductance)`` of all prefixes by falling rank per degree.

    An edge's ends have positions; it leaves the boundary when the later one comes in, so cumulative sums give all cuts.
    """
    ranked = ranks.join(degrees(edges), "node").select("seed", "node", "degree", (F.col("p") / F.col("degree")).alias("q")).where("q > 0")
    placed = cut(running_sums(ranked, ["seed"], [F.desc("q"), F.col("node")], position=F.lit(1).cast("long"), volume="degree"))
    at = lambda side: placed.select(F.col("seed").alias(f"seed_{side}"), F.col("node").alias(side), F.col("position").alias(f"at_{side}"))
    inner = edges.join(at("src"), "src").join(at("dst"), "dst").where("seed_src = seed_dst")
    closing = inner.groupBy(F.col("seed_src").alias("seed"), F.greatest("at_src", "at_dst").alias("position")).agg(F.count(F.lit(1)).alias("closed"))
    total = edges.agg((2 * F.count(F.lit(1))).alias("vol"))
    cum = running_sums(placed.join(closing, ["seed", "position"], "left"), ["seed"], [F.col("position")], inside="coalesce(closed, 0)").crossJoin(F.broadcast(total))
    cum = cum.withColumn("boundary", F.col("volume") - 2 * F.col("inside"))
    return cum.select("seed", F.col("position").cast("int").alias("position"), "node", "volume", "boundary", (F.col("boundary") / F.nullif(F.least(F.col("volume"), F.col("vol") - F.col("volume")), F.lit(0))).alias("conductance"))


def nibble(edges: DataFrame, seeds: DataFrame, phi: float, b: int) -> DataFrame:
    """``(seed, node)``: the first prefix with conductance under ``phi`` and volume between 2^(b-1) and two thirds of the whole."""
    if not 0 < phi <= 1 or b < 1:
        raise ValueError("phi lies in (0, 1], b is 1 or more")
    m = edges.count()
    if m < 2:
        return seeds.select(F.col("node").alias("seed"), "node").limit(0)
    top = math.ceil(math.log2(m))
    if b > top:
        raise ValueError(f"b is at most {top}")
    alpha = phi * phi / (225 * math.log(100 * math.sqrt(m)))
    s = sweep(edges, approximate_pagerank(edges, seeds, alpha, 2.0**-b / (48 * top)))
    first = s.where((F.col("conductance") < phi) & (F.col("volume") > 2 ** (b - 1)) & (F.col("volume") < 4 * m / 3)).groupBy("seed").agg(F.min("position").alias("last"))
    return s.join(first, "seed").where("position <= last").select("seed", "node")


def series_terms(time: float, error: float) -> int:
    """How many terms of exp(-time) * time^k / k! leave no more than ``error`` to the rest."""
    k, term, left = 0, math.exp(-time), 1.0 - math.exp(-time)
    while left > error:
        k += 1
        term *= time / k
        left -= term
        if k > 10 * (time + 10):
            break
    return k + 1


def heat_kernel(edges: DataFrame, sources: DataFrame, time: float, error: float = 1e-9, mode: str = "random_walk") -> DataFrame:
    """``(source, node, value)``: rows of exp(-time * L), by its series.

    ``mode='random_walk'`` takes the random-walk Laplacian, whose rows sum to 1 and miss ``error`` at most: as many terms
    are taken as that asks for, and nothing is dropped. ``mode='combinatorial'`` takes the symmetric one, degree less
    links, by the same series over the largest degree. Each term is one join of the walk so far with the edges.
    """
    if mode == "combinatorial":
        return _symmetric_kernel(edges, sources, time, error)
    terms = series_terms(time, error)
    both = cut(symmetric(edges).join(degrees(edges), "node"))
    walk = cut(sources.select(F.col("node").alias("source"), "node").distinct().join(both.select("node").distinct(), "node", "left_semi").select("source", "node", F.lit(math.exp(-time)).alias("value")))
    total = walk
    for k in range(1, terms):
        walk = walk.join(both, "node").groupBy("source", F.col("neighbour").alias("node")).agg(F.sum(F.col("value") * time / k / F.col("degree")).alias("value"))
        walk = cut(walk)
        total = total.union(walk)
    return total.groupBy("source", "node").agg(F.sum("value").alias("value"))


def _symmetric_kernel(edges: DataFrame, sources: DataFrame, time: float, error: float) -> DataFrame:
    """exp(-t * L) = exp(-t * top) * exp(t * (top - L)); the steps of the second series are never negative."""
    deg = cut(degrees(edges))
    top = deg.agg(F.max("degree").alias("d")).first()["d"] or 0
    both = cut(symmetric(edges))
    walk = cut(sources.select(F.col("node").alias("source"), "node").distinct().join(deg, "node", "left_semi").select("source", "node", F.lit(math.exp(-time * top)).alias("value")))
    total = walk
    for k in range(1, series_terms(time * top, error)):
        there = walk.join(both, "node").select("source", F.col("neighbour").alias("node"), "value")
        stay = walk.join(deg, "node").select("source", "node", (F.col("value") * (top - F.col("degree"))).alias("value"))
        walk = cut(there.union(stay).groupBy("source", "node").agg((F.sum("value") * time / k).alias("value")))
        total = total.union(walk)
    return total.groupBy("source", "node").agg(F.sum("value").alias("value"))


def hot_edges(kernel: DataFrame, edges: DataFrame, scores: DataFrame, method: str = "max") -> DataFrame:
    """``(src, dst, weight)``: the smaller of the heat either end sends the other, times the larger (or mean) score."""
    k = kernel.select(F.col("source").alias("a"), F.col("node").alias("b"), "value")
    e = edges.join(k.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value").alias("there")), ["src", "dst"])
    e = e.join(k.select(F.col("a").alias("dst"), F.col("b").alias("src"), F.col("value").alias("back")), ["src", "dst"])
    e = e.join(scores.select(F.col("node").alias("src"), F.col("score").alias("s1")), "src").join(scores.select(F.col("node").alias("dst"), F.col("score").alias("s2")), "dst")
    score = F.greatest("s1", "s2") if method == "max" else (F.col("s1") + F.col("s2")) / 2
    return e.select("src", "dst", (F.least("there", "back") * score).alias("weight"))


def hot_modules(weights: DataFrame, delta: float) -> DataFrame:
    """``(node, module)``: components of the edges of weight ``delta`` or more."""
    return connected_components(weights.where(F.col("weight") >= delta)).withColumnRenamed("component", "module")


def permuted_scores(scores: DataFrame, permutations: int, seed: str = "h") -> DataFrame:
    """``(perm, node, score)``: scores dealt anew among the nodes by two hash orders, for each permutation."""
    each = scores.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    keyed = lambda tag: F.md5(F.concat_ws(":", F.lit(seed + tag), "perm", "node"))
    nodes = numbered(each.select("perm", "node", keyed("n").alias("h")), ["perm"], [F.col("h"), F.col("node")], "r").drop("h")
    values = numbered(each.select("perm", "node", "score", keyed("s").alias("h")), ["perm"], [F.col("h"), F.col("node")], "r").drop("h", "node")
    return nodes.join(values, ["perm", "r"]).select("perm", "node", "score")


def module_counts(kernel: DataFrame, edges: DataFrame, scores: DataFrame, deltas: list[float], permutations: int = 100, cutoff: float = 0.25) -> DataFrame:
    """``(delta, modules)``: for each delta the modules whose false discovery rate is at most ``cutoff``."""
    spark = edges.sparkSession
    out = []
    for delta in sorted(set(deltas)):
        found = module_significance(kernel, edges, scores, delta, permutations).where(F.col("fdr") <= cutoff)
        out.append(cut(found.agg(F.lit(float(delta)).alias("delta"), F.count(F.lit(1)).alias("modules"))))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "delta double, modules long")


def choose_delta(kernel: DataFrame, edges: DataFrame, scores: DataFrame, deltas: list[float] | None = None, permutations: int = 100, cutoff: float = 0.25, digits: int = 1) -> float | None:
    """The delta of most significant modules, the smallest of equal ones; None where no delta has any.

    The first list is 0.0005 to 0.01 in steps of 0.0005. With more ``digits`` the best is sought anew, one digit finer at
    a time, between the deltas beside it.
    """
    tried = sorted(deltas or [i / 2000 for i in range(1, 21)])
    best = None
    for step in range(digits):
        found = module_counts(kernel, edges, scores, tried, permutations, cutoff).where("modules > 0").orderBy(F.desc("modules"), "delta").first()
        if found is None:
            return best
        best = found["delta"]
        gap = (tried[1] - tried[0] if len(tried) > 1 else best) / 10
        tried = [d for d in (best + i * gap for i in range(-10, 11)) if d > 0]
    return best


def permuted_places(i: np.ndarray, n: int, perm: np.ndarray | int) -> np.ndarray:
    """Where permutation ``perm`` puts each of ``i`` among ``n`` places: a keyed exchange of halves, again for places beyond the last.

    Every permutation is one of all places, so none has to be written or sorted.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(i, dtype=np.uint64).copy()
    key = np.broadcast_to(np.asarray(perm, dtype=np.uint64), out.shape) * np.uint64(0x9E3779B97F4A7C15)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(6):
            x = (right + key[todo] + np.uint64(turn * 0xD1B54A32D192ED03 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _component_sizes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the components of the edges ``a - b`` among ``n`` nodes: of two roots the larger hangs on the smaller, and trees are made flat."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(flat := label[label], label):
            label = flat
    met = np.zeros(n, dtype=bool)
    met[a] = met[b] = True
    sizes = np.bincount(label[met], minlength=n)
    return sizes[sizes > 0]


def _permuted_sizes(links: pd.DataFrame, n: int, first: int, last: int) -> pd.DataFrame:
    """``(perm, null_size, n)``: how many components of each size the edges ``(src, dst, below)`` have that permutations ``first`` to ``last`` keep."""
    ids, at = np.unique(np.concatenate([links["src"], links["dst"]]), return_inverse=True)
    a, b = at[: len(links)], at[len(links) :]
    below, rows = links["below"].to_numpy(), []
    for perm in range(first, last):
        place = permuted_places(ids, n, perm)
        kept = np.maximum(place[a], place[b]) >= below
        rows.append((perm, *np.unique(_component_sizes(a[kept], b[kept], len(ids)), return_counts=True)))
    return pd.DataFrame({"perm": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), "null_size": np.concatenate([r[1] for r in rows]), "n": np.concatenate([r[2] for r in rows])})


def _null_modules(base: DataFrame, scores: DataFrame, delta: float, permutations: int, most_links: int) -> DataFrame:
    """``(perm, null_size, n)``: how many modules of each size permuted scores give the weights ``base``.

    An edge is kept if the larger score of its ends is at least delta over its weight, so only the places of scores in their
    order count: an edge asks for a place, ``below``, that one end must get. Edges that some permutation may keep are dealt
    out by component, and tasks take some of the permutations each.
    """
    spark = base.sparkSession
    placed = settled(numbered(scores, [], [F.asc_nulls_first("score"), F.col("node")], "at").select("node", (F.col("at") - 1).alias("at"), F.col("score").cast("double").alias("score")))
    n = placed.count()

    @F.pandas_udf("double")
    def least(weight: pd.Series) -> pd.Series:
        """The least score that brings a weight to delta, as products round."""
        w = weight.to_numpy(dtype=float)
        with np.errstate(all="ignore"):
            t = delta / w
            for _ in range(3):
                t = np.where(t * w < delta, np.nextafter(t, np.inf), t)
                t = np.where(np.nextafter(t, -np.inf) * w >= delta, np.nextafter(t, -np.inf), t)
        return pd.Series(np.where(w > 0, t, -np.inf if delta <= 0 else np.inf))

    asked = base.select("src", "dst", least("weight").alias("score"), F.lit(0).alias("counts"))
    none = F.lit(None).cast(dict(base.dtypes)["src"])
    both = asked.union(placed.select(none, none, "score", F.lit(1)))
    counted = running_sums(both, [], [F.asc_nulls_first("score"), F.col("counts")], below="counts").where(F.col("src").isNotNull() & (F.col("below") < n))
    at = lambda c: placed.select(F.col("node").alias(c), F.col("at").alias(f"at_{c}"))
    e = settled(counted.join(at("src"), "src").join(at("dst"), "dst").select(F.col("at_src").alias("src"), F.col("at_dst").alias("dst"), "below"))
    width = max(spark.sparkContext.defaultParallelism * 4, 32)
    small, large = dealt_by_component(e, width, most_links)
    turns = -(-permutations // PERMUTATIONS_A_TASK)
    dealt = small.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).repartition(width * min(turns, 8), "deal", "turn").groupBy("deal", "turn")

    def work(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * PERMUTATIONS_A_TASK
        return _permuted_sizes(links, n, first, min(first + PERMUTATIONS_A_TASK, permutations))

    inside = dealt.applyInPandas(work, "perm int, null_size long, n long")
    place = F.pandas_udf(lambda i, perm: pd.Series(permuted_places(i.to_numpy(), n, perm.to_numpy())), "long")
    each = large.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    kept = each.where(F.greatest(place("src", "perm"), place("dst", "perm")) >= F.col("below"))
    name = lambda c: F.struct("perm", F.col(c).alias("id")).alias(c)
    apart = connected_components(kept.select(name("src"), name("dst"))).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    apart = apart.groupBy("component.perm", F.col("size").alias("null_size")).agg(F.count(F.lit(1)).alias("n"))  # sizes are few, modules are not
    return inside.union(apart).groupBy("perm", "null_size").agg(F.sum("n").alias("n"))


def module_significance(kernel: DataFrame, edges: DataFrame, scores: DataFrame, delta: float, permutations: int = 100, most_links: int = MOST_LINKS) -> DataFrame:
    """``(module, size, p_value, fdr)``: how often permuted scores give as many modules of at least that size."""
    scores = settled(scores.groupBy("node").agg(F.max("score").alias("score")))
    base = settled(hot_edges(kernel, edges, scores.withColumn("score", F.lit(1.0))))
    own = base.join(scores.select(F.col("node").alias("src"), F.col("score").alias("s1")), "src").join(scores.select(F.col("node").alias("dst"), F.col("score").alias("s2")), "dst")
    real = hot_modules(own.select("src", "dst", (F.col("weight") * F.greatest("s1", "s2")).alias("weight")), delta).groupBy("module").agg(F.count(F.lit(1)).alias("size"))
    real = settled(real)
    null = settled(_null_modules(base, scores, delta, permutations, most_links))
    sizes = real.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    at_least = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("real_n", F.sum("n").over(at_least))
    seen = sizes.drop("n").join(null, F.col("null_size") >= F.col("size"), "left").groupBy("size", "real_n", "perm").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"))
    rate = seen.groupBy("size", "real_n").agg((F.count(F.when(F.col("k") >= F.col("real_n"), 1)) / permutations).alias("p_value"), F.least(F.lit(1.0), F.sum("k") / permutations / F.first("real_n")).alias("fdr"))
    return real.join(rate, "size").select("module", "size", "p_value", "fdr")
