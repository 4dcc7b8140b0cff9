"""Taking networks apart: clusters left by removing the most travelled edges, and the clique left by dropping nodes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.clustering import spanning_forest
from lattica.operators.components import connected_components
from lattica.operators.modularity import module_scores
from lattica.operators.motifs import edge_betweenness, travelled
from lattica.operators.network import degrees, induced, symmetric, vertices
from lattica.operators.ranking import numbered
from lattica.session import settled

#: Components that are worked off inside tasks go in batches of about so many edges.
ROWS_A_BATCH = 20_000
#: Components of at most so many edges are worked off inside a task, larger ones by joins, an edge a round of each.
MOST_EDGES = 10_000
#: Pieces of at most so many nodes are counted through as dense matrices.
DENSE = 300


def _travelled(linked: np.ndarray) -> np.ndarray:
    """How many shortest paths between all pairs use each edge of a dense network: forward by levels from all nodes at once, then back."""
    n = len(linked)
    paths, seen = np.eye(n), np.eye(n, dtype=bool)
    levels = [paths]
    while True:
        reach = levels[-1] @ linked
        reach[seen] = 0.0
        if not reach.any():
            break
        seen |= reach > 0
        paths = paths + reach
        levels.append(reach)
    flow, below = np.zeros((n, n)), np.zeros((n, n))
    for up, down in zip(levels[-2::-1], levels[:0:-1]):
        share = np.where(down > 0, (1.0 + below) / np.where(down > 0, down, 1.0), 0.0)
        flow += up.T @ share * linked
        below += up * (share @ linked)
    return (flow + flow.T) / 2


def _counted(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many shortest paths use each edge ``a - b`` of a piece of ``n`` nodes."""
    if n <= DENSE:
        linked = np.zeros((n, n))
        linked[a, b] = linked[b, a] = 1.0
        return _travelled(linked)[a, b]
    x, y, edge = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    order = np.argsort(x, kind="stable")
    flows, _ = travelled(x[order], y[order], np.zeros(n, dtype=np.int64), np.arange(n))
    return np.bincount(edge[order], weights=flows, minlength=len(a)) / 2


def _reached(near: list[set], start: int) -> set:
    met, front = {start}, [start]
    while front:
        front = [y for x in front for y in near[x] if y not in met and not met.add(y)]
    return met


def _one_by_one(src: np.ndarray, dst: np.ndarray, most: int) -> list[tuple]:
    """``(src, dst, step, turn)`` of a component's edges in order of removal, the most travelled of what is left each time, ties to the smaller ends.

    A removal changes the paths of the piece it was in only, so only that one, or the two that it falls into, are counted anew.
    """
    ids = np.unique(np.concatenate([src, dst]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    near = [set() for _ in ids]
    edge = {}
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        near[x].add(y)
        near[y].add(x)
        edge[x, y] = k
    value, out, turn = np.full(len(a), -np.inf), [], np.inf

    def count(piece: set) -> None:
        nodes = np.array(sorted(piece))
        own = np.array(sorted(edge[x, y] for x in piece for y in near[x] if x < y), dtype=np.int64)
        if len(own):
            value[own] = np.round(_counted(np.searchsorted(nodes, a[own]), np.searchsorted(nodes, b[own]), len(nodes)), 9)

    count(set(range(len(ids))))
    for step in range(min(most, len(src))):
        k = int(np.argmax(value))
        turn = min(turn, float(value[k]))
        out.append((ids[a[k]], ids[b[k]], step, turn))
        value[k] = -np.inf
        x, y = int(a[k]), int(b[k])
        near[x].discard(y)
        near[y].discard(x)
        count(piece := _reached(near, x))
        if y not in piece:
            count(_reached(near, y))
    return out


def _each_apart(links: pd.DataFrame, most: int) -> pd.DataFrame:
    """``(component, src, dst, step, turn)`` for the components of ``links(component, src, dst)``, one after another."""
    links = links.sort_values("component", kind="stable")
    name, src, dst = (links[c].to_numpy() for c in ("component", "src", "dst"))
    ends = np.append(np.flatnonzero(name[1:] != name[:-1]) + 1, len(name))
    rows = [(name[a], *row) for a, b in zip(np.append(0, ends[:-1]), ends) for row in _one_by_one(src[a:b], dst[a:b], most)]
    return pd.DataFrame(rows, columns=["component", "src", "dst", "step", "turn"])


def _rounds(left: DataFrame, most: int) -> DataFrame:
    """``(component, src, dst, step, turn)`` of edges ``(component, src, dst)`` as by ``_one_by_one``, by joins: the most travelled edge of every component goes in each round."""
    turns = left.select("component", F.lit(float("inf")).alias("turn")).distinct()
    turns, taken = settled(turns), []
    for step in range(most):
        if left.isEmpty():
            break
        now = edge_betweenness(left.select("src", "dst")).join(left, ["src", "dst"])
        first = F.min(F.struct((-F.round("betweenness", 9)).alias("least"), "src", "dst")).alias("e")
        top = now.groupBy("component").agg(first).join(turns, "component")
        top = settled(top.select("component", "e.src", "e.dst", F.lit(step).cast("long").alias("step"), F.least("turn", -F.col("e.least")).alias("turn")))
        taken.append(top)
        turns = top.select("component", "turn")
        left = settled(left.join(top, ["src", "dst"], "left_anti").select("component", "src", "dst"), left)
    return reduce(DataFrame.union, taken)


def removal_order(edges: DataFrame, share: float = 0.3, largest: int | None = None, rounds: int = 10, most_edges: int = MOST_EDGES) -> DataFrame:
    """``(src, dst, place)``: the first ``share`` of all edges in the order in which the most travelled one is removed, from 1.

    Components do not touch each other's paths, so each of at most ``most_edges`` edges is worked off inside a task, many in a
    batch; larger ones by joins, an edge a round. Either way edges go one at a time, so the size does not change the order.
    The orders are merged as a reader would who always
    takes the component whose next edge is travelled most: an edge waits for every edge before it in its component, so its
    turn comes with the least betweenness up to it. Only if ``largest`` is given do edges of components of more nodes than that go in
    ``rounds`` batches, as ``betweenness_clusters`` does: fewer rounds, and another order.
    """
    e = settled(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    most = int(e.count() * share)
    if most == 0:
        return e.select("src", "dst", F.lit(0).cast("long").alias("place")).limit(0)
    comp = settled(connected_components(e))
    keyed = settled(e.join(comp.withColumnRenamed("node", "src"), "src").select("component", "src", "dst"))
    sizes = keyed.groupBy("component").agg(F.count(F.lit(1)).alias("edges")).join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")), "component")
    batched = F.lit(False) if largest is None else F.col("nodes") > largest
    sizes = settled(sizes.select("component", batched.alias("batched"), (F.col("edges") <= most_edges).alias("fits")))
    type_ = dict(e.dtypes)["src"]

    # A fixed number of tasks: the components are few small rows, and much work.
    inside = settled(keyed.join(sizes.where(~F.col("batched") & F.col("fits")), "component", "left_semi"))
    width = max(e.sparkSession.sparkContext.defaultParallelism * 8, -(-inside.count() // ROWS_A_BATCH))
    dealt = inside.withColumn("batch", F.pmod(F.xxhash64("component"), F.lit(width)).cast("int")).repartition(width, "batch").groupBy("batch")
    out = f"component {type_}, src {type_}, dst {type_}, step long, turn double"
    orders = [settled(dealt.applyInPandas(lambda links: _each_apart(links, most), out))]  # numbering reads it twice
    large = settled(keyed.join(sizes.where(~F.col("batched") & ~F.col("fits")), "component", "left_semi"))
    if not large.isEmpty():
        orders.append(_rounds(large, most))
    left = settled(keyed.join(sizes.where("batched"), "component", "left_semi"))
    orders += _batches(left, most, rounds)
    merged = numbered(reduce(DataFrame.union, orders), [], [F.desc("turn"), F.col("component"), F.col("step")], "place")
    return merged.where(F.col("place") <= most).select("src", "dst", "place")


def _batches(left: DataFrame, most: int, rounds: int) -> list[DataFrame]:
    """``(component, src, dst, step, turn)`` of edges ``(component, src, dst)`` that go in ``rounds`` batches of the most travelled ones; none without edges."""
    batches = []
    total, gone = left.count(), 0
    for i in range(1, rounds + 1):
        take = round(min(most, total) * i / rounds) - gone
        if take > 0:
            now = settled(edge_betweenness(left.select("src", "dst")))
            most_travelled = numbered(now, [], [F.round("betweenness", 9).desc(), F.col("src"), F.col("dst")], "at").where(F.col("at") <= take)
            top = settled(most_travelled.drop("at").join(left, ["src", "dst"]))
            placed = numbered(top, ["component"], [F.round("betweenness", 9).desc(), F.col("src"), F.col("dst")])
            batches.append(placed.select("component", "src", "dst", (F.col("rank") + i * total).alias("step"), F.round("betweenness", 9).alias("own"), F.lit(i).alias("batch")))
            left = settled(left.join(top, ["src", "dst"], "left_anti").select("component", "src", "dst"), left)
            gone += take
    if not batches:
        return []
    # A batch falls from its first edge on; before it, only the least of each earlier batch counts.
    found = settled(reduce(DataFrame.union, batches))
    before = F.min("least").over(Window.partitionBy("component").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    least = found.groupBy("component", "batch").agg(F.min("own").alias("least")).withColumn("least", before)
    return [found.join(least, ["component", "batch"]).select("component", "src", "dst", "step", F.least("own", "least").alias("turn"))]


def removal_sweep(edges: DataFrame, order: DataFrame, shares: list[float] | None = None) -> DataFrame:
    """``(removed, modularity, clusters)`` for every number of edges removed that ``shares`` of the network give, 0 to 0.3 by 0.005 at first.

    A cut keeps the edges that are removed later. Only edges of a spanning forest by time of removal can join clusters at
    any cut, so all cuts' components are found on the forest, in one job keyed by cut; modularity counts all edges.
    """
    return _swept(edges, order, shares)[0]


def _swept(edges: DataFrame, order: DataFrame, shares: list[float] | None) -> tuple[DataFrame, DataFrame]:
    e = settled(edges.select("src", "dst").distinct())
    m = e.count()
    shares = shares if shares is not None else [i / 200 for i in range(61)]
    cuts = sorted({int(m * s + 1e-9) for s in shares})
    timed = e.join(order, ["src", "dst"], "left").select("src", "dst", F.coalesce("place", F.lit(m + 1)).alias("place"))
    forest = settled(spanning_forest(timed.select("src", "dst", (-F.col("place")).cast("double").alias("distance"))))
    at = F.explode(F.array(*[F.lit(c).cast("long") for c in cuts])).alias("net")
    joined = forest.select("src", "dst", "distance", at).where(-F.col("distance") > F.col("net"))
    key = lambda c: F.struct("net", F.col(c).alias("id")).alias(c)
    comp = connected_components(joined.select(key("src"), key("dst"))).select("node.net", F.col("node.id").alias("node"), F.col("component.id").alias("cluster"))
    every = vertices(e).select("node", at)
    clusters = settled(every.join(comp, ["net", "node"], "left").select("net", "node", F.coalesce("cluster", "node").alias("cluster")))
    scores = module_scores(e.select("src", "dst", at), clusters).groupBy("net").agg(F.sum("modularity").alias("modularity"), F.count(F.lit(1)).alias("clusters"))
    return settled(scores.select(F.col("net").alias("removed"), "modularity", "clusters")), clusters


def best_removal(edges: DataFrame, shares: list[float] | None = None, largest: int | None = None, rounds: int = 10, digits: int = 9) -> DataFrame:
    """``(removed, modularity, node, cluster)``: the clusters of the cut of most modularity, the fewest edges removed of equal ones.

    Modularities are compared to ``digits`` places. No cut above 0 gives no rows.
    """
    shares = shares if shares is not None else [i / 200 for i in range(61)]
    swept, clusters = _swept(edges, removal_order(edges, max(shares, default=0.0), largest, rounds), shares)
    best = swept.where(F.round("modularity", digits) > 0).agg(F.max_by(F.struct("removed", "modularity"), F.struct(F.round("modularity", digits), -F.col("removed"))).alias("b")).select("b.*")
    return clusters.join(best, clusters["net"] == best["removed"]).select("removed", "modularity", "node", "cluster")


def _dropped(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the nodes that stay when, again and again, of the first pair without a link the end of fewer links goes, the second of equal ones."""
    near = [set() for _ in ids]
    for x, y in zip(a.tolist(), b.tolist()):
        near[x].add(y)
        near[y].add(x)
    alive = dict.fromkeys(i for i in range(len(ids)) if near[i])

    def drop(x: int) -> None:
        alive.pop(x, None)
        for y in near[x]:
            near[y].discard(x)
            if not near[y]:
                alive.pop(y, None)
        near[x] = set()

    for first in range(len(ids)):
        if first not in alive:
            continue
        for other in [y for y in alive if y > first and y not in near[first]]:
            if other not in alive:
                continue
            if len(near[first]) < len(near[other]):
                drop(first)
                break
            drop(other)
    return np.array(list(alive), dtype=np.int64)


def greedy_clique(edges: DataFrame, most_edges: int = 200_000) -> DataFrame:
    """``(node)``: the clique left when, of the first pair of nodes without a link, the end of fewer links goes (the second of equal ones), again and again.

    Pairs are read in order of their ids, and nodes without links fall out. The first node meets all it has no link to in one
    round: its own links stay, so it goes at the first of them that then has more links, and those before that go; how many
    links one has then is how many it has less those to the ones before it, one join. A node that no one outlasts has met
    all others. Rounds by joins go on until at most ``most_edges`` are left; those are worked off inside one task.
    """
    e = settled(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    last = None
    while e.count() > most_edges:
        d = settled(degrees(e))
        rest = d if last is None else d.where(F.col("node") > F.lit(last))
        first = rest.orderBy("node").first()
        if first is None:
            return vertices(e)
        near = symmetric(e).where(F.col("node") == F.lit(first["node"])).select(F.col("neighbour").alias("node"))
        # Nodes before it have met it already.
        apart = settled(rest.where(F.col("node") > F.lit(first["node"])).join(near, "node", "left_anti"))
        inner = induced(e, apart).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("before"))
        stays = apart.join(inner, "node", "left").where(F.col("degree") - F.coalesce("before", F.lit(0)) > first["degree"]).agg(F.min("node").alias("n")).first()["n"]
        gone = apart.select("node") if stays is None else apart.where(F.col("node") < F.lit(stays)).select("node").union(d.where(F.col("node") == F.lit(first["node"])).select("node"))
        e = settled(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), e)
        last = first["node"]
    type_ = dict(e.dtypes)["src"]

    def work(links: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([links["src"], links["dst"]]))
        return pd.DataFrame({"node": ids[_dropped(ids, np.searchsorted(ids, links["src"]), np.searchsorted(ids, links["dst"]))]})

    return e.groupBy().applyInPandas(work, f"node {type_}")


def grown_clique(edges: DataFrame, clique: DataFrame) -> DataFrame:
    """``(node, added)``: the clique with further nodes that are linked to all of it, the smallest first, until none is left."""
    both = settled(symmetric(edges))
    own = settled(clique.select("node", F.lit(False).alias("added")).distinct())
    while True:
        n = own.count()
        near = both.join(own.select("node"), "node").groupBy(F.col("neighbour").alias("node")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == n)
        new = near.join(own, "node", "left_anti").agg(F.min("node").alias("node")).where("node is not null").select("node", F.lit(True).alias("added"))
        grown = settled(own.union(new))
        if grown.count() == n:
            return own
        own = settled(grown, own, grown)


def prefix_clique(edges: DataFrame, names: DataFrame, prefix: str, most_edges: int = 200_000) -> DataFrame:
    """``(node, added)``: the greedy clique among nodes whose ``names(node, name)`` begin with ``prefix``, grown in the whole network."""
    own = names.where(F.startswith("name", F.lit(prefix))).select("node").distinct()
    return grown_clique(edges, greedy_clique(induced(edges, own), most_edges))
