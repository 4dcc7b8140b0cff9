"""Distances and shortest paths from many sources at once, by frontier joins: breadth first, by weights, by ranked edges, and from both ends."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.components import connected_components
from lattica.operators.network import clustering_coefficient, degrees, symmetric, vertices
from lattica.operators.random_nets import random_graph, random_pairs
from lattica.operators.ranking import numbered
from lattica.session import cut, remove, settled

#: Components of at most so many links, either direction counted, are searched inside tasks; larger ones by joins.
MOST_LINKS = 2_000_000
#: A task searches from so many sources at a time that sources times nodes are about this many, and from one at least.
CELLS = 1_000_000


def distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``(source, node, distance)``, 0 to itself; unreachable nodes and sources outside the network have no row.

    ``max_depth`` searches no further. With ``targets(node)`` the search stops when every source has met all of them.
    A neighbour of a level lies in it, before it or after it, so a level is held against the last two only, and levels
    stay as they were written until the end.
    """
    both = cut(symmetric(edges))
    start = _within(sources, both)
    levels = [cut(start.select("source", F.col("source").alias("node")))]
    wanted = None if targets is None else cut(targets.select("node").distinct())
    left = None if wanted is None else levels[0].count() * wanted.join(both.select("node").distinct(), "node", "left_semi").count()
    while max_depth is None or len(levels) <= max_depth:
        if left is not None:
            left -= levels[-1].join(wanted, "node", "left_semi").count()
            if left <= 0:
                break
        step = levels[-1].join(both, "node").select("source", F.col("neighbour").alias("node")).distinct()
        fresh = cut(step.join(_union(levels[-2:]), ["source", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
    seen = _union([level.withColumn("distance", F.lit(i)) for i, level in enumerate(levels)])
    return seen if wanted is None else seen.join(wanted, "node", "left_semi").select("source", "node", "distance")


def _within(sources: DataFrame, both: DataFrame) -> DataFrame:
    return sources.select(F.col("node").alias("source")).distinct().join(both.select(F.col("node").alias("source")).distinct(), "source", "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(source, node, path)``: one shortest path each, the one whose predecessors are smallest from the end backward."""
    both = cut(symmetric(edges))
    levels = [cut(_within(sources, both).select("source", F.col("source").alias("node"), F.array("source").alias("path")))]
    while max_depth is None or len(levels) <= max_depth:
        step = levels[-1].join(both, "node").select("source", F.col("neighbour"), "node", "path")
        best = step.groupBy("source", F.col("neighbour").alias("node")).agg(F.min_by("path", step["node"]).alias("path"))
        old = _union([level.select("source", "node") for level in levels[-2:]])
        fresh = cut(best.join(old, ["source", "node"], "left_anti").select("source", "node", F.array_append("path", F.col("node")).alias("path")))
        if fresh.isEmpty():
            break
        levels.append(fresh)
    return _union(levels)


def path_edges(paths: DataFrame) -> DataFrame:
    """``(source, node, src, dst)``: the consecutive edges of each path, smaller end first."""
    e = paths.where(F.size("path") > 1).select("source", "node", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("e"))
    return e.select("source", "node", F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst"))


def set_distance(edges: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: mean of the least distances from the first set to the second and back, and the mean over all pairs that are connected."""
    d = distances(edges, first, targets=second)
    by_source = d.groupBy("source").agg(F.min("distance").alias("m"))
    by_target = d.groupBy("node").agg(F.min("distance").alias("m"))
    least = by_source.select("m").union(by_target.select("m")).agg(F.avg("m").alias("mean_min_distance"))
    return least.crossJoin(d.agg(F.avg("distance").alias("mean_distance"), F.count(F.lit(1)).alias("pairs")))


def _weighted(edges: DataFrame) -> DataFrame:
    """Both directions of ``(src, dst, weight)``, the least weight of repeated edges; null ends and self-loops are left out."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour"))))
    return e.select(both.alias("e"), "weight").select("e.node", "e.neighbour", "weight")


def _batched(both: DataFrame, start: DataFrame, most_links: int, work, out: str) -> tuple[DataFrame, DataFrame]:
    """``work(links, sources)`` of every batch of the sources ``start(source)`` and the links of their component, and the sources whose components have more than ``most_links``.

    ``links`` is the Arrow table of the rows of ``both(node, neighbour, ...)``.
    """
    comp = settled(connected_components(both, "node", "neighbour"))
    ours = start.join(comp.withColumnRenamed("node", "source"), "source")
    sizes = both.join(comp, "node").groupBy("component").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("node").alias("nodes"))
    ours = settled(ours.join(sizes, "component").select("source", "component", "links", "nodes"))
    small = ours.where(F.col("links") <= most_links)
    batches = F.ceil(F.count(F.lit(1)) / F.greatest(F.floor(F.lit(CELLS) / F.first("nodes")), F.lit(1))).cast("int")
    each = settled(small.groupBy("component").agg(batches.alias("batches")))
    dealt = small.join(each, "component").select("component", F.pmod(F.xxhash64("source"), F.col("batches")).cast("int").alias("batch"), "source")
    links = both.join(comp, "node").join(each, "component").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")
    width = max(both.sparkSession.sparkContext.defaultParallelism * 4, 32)  # a fixed number: batches are few small rows each, and much work
    key = ["component", "batch"]
    found = dealt.repartition(width, *key).groupBy(*key).cogroup(links.repartition(width, *key).groupBy(*key)).applyInArrow(lambda sources, links: work(links, sources), out)
    return found, ours.where(F.col("links") > most_links).select("source")


def _indexed(links: pa.Table, sources: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a component, and the places among them of both ends of its links and of the sources."""
    ids = pc.unique(links["node"].combine_chunks())
    at = lambda c: pc.index_in(c, value_set=ids).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, at(links["node"]), at(links["neighbour"]), at(sources["source"])


def _nearest(links: pa.Table, sources: pa.Table, farthest: float | None) -> pa.Table:
    """``(source, node, distance)`` of a component, of nodes ``wanted`` if links have that.

    The nodes whose distance fell wait; of all sources those that are nearest, within a mean weight, go on first, so that few are met again.
    """
    if not len(sources) or not len(links):
        return pa.table({"source": sources["source"][:0], "node": sources["source"][:0], "distance": pa.array([], pa.float64())})
    ids, a, b, start = _indexed(links, sources)
    n, order = len(ids), np.argsort(a, kind="stable")
    b, weight = b[order], links["weight"].to_numpy()[order]
    first, step = np.searchsorted(a[order], np.arange(n + 1)), weight.mean()
    far, place = np.full(len(start) * n, np.inf), np.empty(len(start) * n, dtype=np.int64)
    waiting = np.arange(len(start)) * n + start
    far[waiting] = 0.0
    while len(waiting):
        known = far[waiting]
        near = known <= known.min() + step
        now, later = waiting[near], waiting[~near]
        node = now % n
        many = first[node + 1] - first[node]
        total = np.cumsum(many)
        link = np.arange(total[-1]) + np.repeat(first[node] - total + many, many)
        cell, distance = np.repeat(now - node, many) + b[link], np.repeat(known[near], many) + weight[link]
        better = distance < far[cell]
        if farthest is not None:
            better &= distance <= farthest
        cell = cell[better]
        np.minimum.at(far, cell, distance[better])
        waiting = np.concatenate([later, cell])
        place[waiting] = np.arange(len(waiting))
        waiting = waiting[place[waiting] == np.arange(len(waiting))]
    met = np.isfinite(far)
    if "wanted" in links.column_names:
        met &= np.tile(links["wanted"].to_numpy(zero_copy_only=False)[order][first[:-1]], len(start))
    cell = np.flatnonzero(met)
    return pa.table({"source": ids.take(pa.array(start[cell // n])), "node": ids.take(pa.array(cell % n)), "distance": far[cell]})


def _queued(links: pa.Table, sources: pa.Table) -> pa.Table:
    """``(source, node, parent, level, place)`` of a component: queues of all sources, level by level, their links in order of rank, then of the neighbour.

    In that order the first link that meets a node is from its parent, and the nodes met come in the order of their level.
    """
    if not len(sources) or not len(links):
        none = sources["source"][:0]
        return pa.table({"source": none, "node": none, "parent": none, "level": pa.array([], pa.int32()), "place": pa.array([], pa.int64())})
    links = links.take(pc.sort_indices(links, [("node", "ascending"), ("rank", "ascending"), ("neighbour", "ascending")]))
    ids, a, b, start = _indexed(links, sources)
    n = len(ids)
    first = np.searchsorted(a, np.arange(n + 1))
    met = np.zeros(len(start) * n, dtype=bool)
    earliest = np.zeros(len(start) * n, dtype=np.int64)
    of, node, parent, out, level = np.arange(len(start)), start, np.full(len(start), -1), [], 0
    while len(of):
        met[of * n + node] = True
        out.append((of, node, parent, np.full(len(of), level, dtype=np.int32), np.arange(len(of)) - np.searchsorted(of, of) + 1))
        many = first[node + 1] - first[node]
        links_of = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[node], many)
        of, parent, node = np.repeat(of, many), np.repeat(node, many), b[links_of]
        key = of * n + node
        fresh = ~met[key]
        of, parent, node, key = of[fresh], parent[fresh], node[fresh], key[fresh]
        earliest[key[::-1]] = np.arange(len(key))[::-1]
        fresh = earliest[key] == np.arange(len(key))
        of, parent, node, level = of[fresh], parent[fresh], node[fresh], level + 1
    of, node, parent, levels, place = (np.concatenate(x) for x in zip(*out))
    return pa.table({"source": ids.take(pa.array(start[of])), "node": ids.take(pa.array(node)), "parent": ids.take(pa.array(parent, mask=parent < 0)), "level": levels, "place": place})


def weighted_distances(edges: DataFrame, sources: DataFrame, width: float | None = None, farthest: float | None = None, most_links: int = MOST_LINKS, targets: DataFrame | None = None) -> DataFrame:
    """``(source, node, distance)``: the least sum of ``edges(src, dst, weight)`` weights from each of ``sources(node)``.

    Components of at most ``most_links`` links are searched inside tasks, a batch of sources each. In larger ones
    distances are settled bucket by bucket of ``width``, by default four times the mean weight: wide buckets take fewer
    rounds, of more rows each. Within a bucket light edges, of at most
    that width, are relaxed until nothing changes, then the heavy ones once from all that the bucket settled: every edge of
    a node is relaxed from its final distance, and nodes beyond the bucket wait. Only rows that wait are written again; what
    a bucket settled stays as it was written. Weights must be positive; a null one is an error as well. ``farthest`` stops
    the search at that distance. With ``targets(node)`` only their rows come out of the tasks.
    """
    both = _weighted(edges)
    wanted = None if targets is None else settled(targets.select("node").distinct())
    if wanted is not None:
        both = both.join(wanted.withColumn("wanted", F.lit(True)), "node", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    both = settled(both)
    facts = both.agg(F.count_if(F.coalesce(F.col("weight") <= 0, F.lit(True))).alias("bad"), F.avg("weight").alias("mean")).first()
    if facts["bad"]:
        raise ValueError("weights must be positive")
    type_ = dict(both.dtypes)["node"]
    found, left = _batched(both, _within(sources, both), most_links, lambda links, of: _nearest(links, of, farthest), f"source {type_}, node {type_}, distance double")
    if left.isEmpty():
        return found
    far = _by_buckets(both, left, width or 4 * (facts["mean"] or 0.25), farthest)
    return found.union(far if wanted is None else far.join(wanted, "node", "left_semi").select("source", "node", "distance"))


def _by_buckets(both: DataFrame, start: DataFrame, width: float, farthest: float | None) -> DataFrame:
    """The distances of ``weighted_distances`` from ``start(source)``, by joins."""
    light, heavy = both.where(F.col("weight") <= width), both.where(F.col("weight") > width)
    waiting = settled(start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance")))
    done: list[DataFrame] = []

    def beyond(rows: DataFrame, edges: DataFrame) -> DataFrame:
        step = rows.join(edges, "node").select("source", F.col("neighbour").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        return step if farthest is None else step.where(F.col("distance") <= farthest)

    least = lambda df: df.groupBy("source", "node").agg(F.min("distance").alias("distance"))
    while True:
        low = waiting.agg(F.min("distance").alias("d")).first()["d"]
        if low is None:
            break
        end = (low // width + 1) * width
        bucket = settled(waiting.where(F.col("distance") < end))
        later = [waiting.where(F.col("distance") >= end)]
        parts, fresh = [bucket], bucket
        while not fresh.isEmpty():  # nodes whose distance in the bucket fell
            reached = settled(least(beyond(fresh, light)))
            later.append(reached.where(F.col("distance") >= end))
            near = reached.where(F.col("distance") < end)
            if done:  # a light edge leads back to the bucket before, but no further
                near = near.join(done[-1].select("source", "node"), ["source", "node"], "left_anti")
            old = least(_union(parts)).withColumnRenamed("distance", "known")
            fresh = settled(near.join(old, ["source", "node"], "left").where("known is null or distance < known").select("source", "node", "distance"))
            parts.append(fresh)
        bucket = settled(least(_union(parts)), *parts) if len(parts) > 2 else bucket
        done.append(bucket)
        ahead = least(reduce(DataFrame.union, [*later, beyond(bucket, heavy)]))
        reached_before = _union([x.select("source", "node") for x in done])  # never nearer by a later bucket
        waiting = settled(ahead.join(reached_before, ["source", "node"], "left_anti"))
    return _union(done) if done else start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"))


def ranked_search(edges: DataFrame, sources: DataFrame, ranks: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """``(source, node, parent, level, place)``: breadth-first trees whose queues take edges in order of rank.

    ``ranks(node, neighbour, rank)`` orders the edges out of a node, ties by neighbour. A queue reaches a node first from the
    node that stands first in the level before, so that is its parent; among the children of all parents the order of a
    level is that of the parents, then of the ranks. ``place`` numbers a level's nodes from 1 in that order. Components of at
    most ``most_links`` links are searched inside tasks, a batch of sources each; larger ones by joins, level by level.
    """
    ordered = settled(symmetric(edges).join(ranks.select("node", "neighbour", "rank"), ["node", "neighbour"], "left").select("node", "neighbour", F.coalesce(F.col("rank").cast("double"), F.lit(float("inf"))).alias("rank")))
    type_ = dict(ordered.dtypes)["node"]
    found, left = _batched(ordered, _within(sources, ordered), most_links, _queued, f"source {type_}, node {type_}, parent {type_}, level int, place long")
    return found if left.isEmpty() else found.union(_by_levels(ordered, left))


def _by_levels(ordered: DataFrame, start: DataFrame) -> DataFrame:
    """The trees of ``ranked_search`` from ``start(source)``, by joins."""
    type_ = dict(ordered.dtypes)["node"]
    levels = [settled(start.select("source", F.col("source").alias("node"), F.lit(None).cast(type_).alias("parent"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("place")))]
    while True:
        step = levels[-1].select("source", "node", "place").join(ordered, "node")
        first = F.min(F.struct(F.col("place").alias("at"), "rank", F.col("node").alias("parent"))).alias("f")
        best = step.groupBy("source", F.col("neighbour").alias("node")).agg(first)
        fresh = best.join(_union([x.select("source", "node") for x in levels[-2:]]), ["source", "node"], "left_anti").select("source", "node", "f.*")
        fresh = settled(fresh)
        if fresh.isEmpty():
            remove(fresh)
            return _union(levels)
        placed = numbered(fresh, ["source"], [F.col("at"), F.col("rank"), F.col("node")], "place")
        levels.append(settled(placed.select("source", "node", "parent", F.lit(len(levels)).alias("level"), "place"), fresh))


def edge_ranks(edges: DataFrame, members: DataFrame, curated: DataFrame, scores: DataFrame) -> DataFrame:
    """``(node, neighbour, rank)``: the order in which a node's edges are taken, from 1.

    Neighbours of lower degree go first; then curated edges ``(src, dst)``; then members ``(node)``; then those of larger
    absolute score ``(node, score)``, scored ones before others; then the smaller id.
    """
    of = symmetric(edges).join(degrees(edges).select(F.col("node").alias("neighbour"), "degree"), "neighbour")
    of = of.join(symmetric(curated).distinct().withColumn("is_curated", F.lit(1)), ["node", "neighbour"], "left")
    of = of.join(members.select(F.col("node").alias("neighbour")).distinct().withColumn("is_member", F.lit(1)), "neighbour", "left")
    of = of.join(scores.groupBy(F.col("node").alias("neighbour")).agg(F.max(F.abs("score")).alias("size")), "neighbour", "left")
    order = [F.col("degree"), F.coalesce("is_curated", F.lit(0)).desc(), F.coalesce("is_member", F.lit(0)).desc(), F.col("size").desc_nulls_last(), F.col("neighbour")]
    return numbered(of, ["node"], order).select("node", "neighbour", F.col("rank").cast("double").alias("rank"))


def tree_paths(trees: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, node, path)``: the paths of ``ranked_search`` trees to ``targets(node)``, walked back level by level."""
    deepest = trees.join(targets.select("node").distinct(), "node", "left_semi")
    walk = settled(deepest.select("source", "node", F.col("node").alias("at"), F.array("node").alias("path"), "parent"))
    out = []
    while True:
        out.append(walk.where("parent is null").select("source", "node", "path"))
        on = walk.where("parent is not null")
        if on.isEmpty():
            return _union(out)
        up = trees.select("source", F.col("node").alias("parent"), F.col("parent").alias("above"))
        walk = settled(on.join(up, ["source", "parent"]).select("source", "node", F.col("parent").alias("at"), F.array_prepend("path", F.col("parent")).alias("path"), F.col("above").alias("parent")))


def spanning_paths(edges: DataFrame, members: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(src, dst)``: the edges of the ranked paths from the smallest member of the network to every member it reaches."""
    own = settled(members.select("node").distinct().join(vertices(edges), "node", "left_semi"))
    trees = settled(ranked_search(edges, own.agg(F.min("node").alias("node")).where("node is not null"), ranks))
    return path_edges(tree_paths(trees, own)).select("src", "dst").distinct()


def pair_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(net, src, dst, distance)`` for named pairs ``(net, src, dst)`` of keyed networks ``(net, src, dst)``; null if they are not connected.

    Both ends are searched, a level each in turn, until their fronts meet; so a search goes half as deep as from one end. A
    pair leaves when it has met, or when a front is empty. Pairs of different components are not searched. Fronts and
    links are not broadcast, which would bring them to the driver.
    """
    e = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour"))))
    both = settled(edges.select("net", e.alias("e")).select("net", "e.*").distinct())
    key = ["net", "a", "b"]
    named = settled(pairs.select("net", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    met = [named.where("a = b").select(*key, F.lit(0).alias("distance"))]
    parts = settled(connected_components(both.select(F.struct("net", "node").alias("src"), F.struct("net", F.col("neighbour").alias("node")).alias("dst"))))
    part = lambda c: parts.select("node.net", F.col("node.node").alias(c), F.col("component").alias(f"part_{c}"))
    apart = settled(named.where("a <> b").join(part("a"), ["net", "a"]).join(part("b"), ["net", "b"]).where("part_a = part_b").select(*key))
    sides = {s: [settled(apart.select(*key, F.col(s).alias("node")))] for s in ("a", "b")}
    active, depth = settled(apart), 0
    while not active.isEmpty():
        s = "ab"[depth % 2]
        other = sides["ab"[1 - depth % 2]][-1]
        front = sides[s][-1].join(active, key, "left_semi").join(both.hint("merge"), ["net", "node"]).select(*key, F.col("neighbour").alias("node")).distinct()
        front = settled(front.join(_union(sides[s][-2:]).hint("merge"), [*key, "node"], "left_anti"))
        sides[s].append(front)
        depth += 1
        found = settled(front.join(other.hint("merge"), [*key, "node"], "left_semi").select(*key).distinct())
        met.append(found.withColumn("distance", F.lit(depth)))
        active = settled(active.join(found, key, "left_anti").join(front.select(*key).distinct(), key, "left_semi"), active)
    return named.join(_union(met), key, "left").select("net", F.col("a").alias("src"), F.col("b").alias("dst"), "distance")


def path_length_histogram(edges: DataFrame, n: int, seed: str = "pairs") -> DataFrame:
    """``(distance, pairs)``: how long shortest paths between ``n`` distinct random pairs of nodes are; null for pairs apart."""
    pairs = random_pairs(vertices(edges), n, seed=seed)
    net = lambda df: df.select(F.lit(0).alias("net"), "src", "dst")
    return pair_distances(net(edges), net(pairs)).groupBy("distance").agg(F.count(F.lit(1)).alias("pairs"))


def random_networks(edges: DataFrame, networks: int, seed: str = "net") -> DataFrame:
    """``(net, src, dst)``: networks of as many random edges among the same nodes, numbered from 0."""
    own = settled(vertices(edges))
    m = edges.count()
    return _union([random_graph(own, m, f"{seed}{i}").select(F.lit(i).alias("net"), "src", "dst") for i in range(networks)])


def random_path_lengths(edges: DataFrame, networks: int = 6, n: int = 1000, seed: str = "net") -> DataFrame:
    """``(net, distance, pairs)``: path lengths of ``n`` random pairs in each of several random networks, all searched in one job."""
    nets = settled(random_networks(edges, networks, seed))
    own = settled(vertices(edges))
    pairs = _union([random_pairs(own, n, seed=f"{seed}p{i}").select(F.lit(i).alias("net"), "src", "dst") for i in range(networks)])
    return pair_distances(nets, pairs).groupBy("net", "distance").agg(F.count(F.lit(1)).alias("pairs"))


def random_cliqueness(edges: DataFrame, networks: int = 10, seed: str = "net") -> DataFrame:
    """``(net, cliqueness)``: mean clustering coefficient of each of several random networks, over its linked nodes."""
    nets = settled(random_networks(edges, networks, seed))
    keyed = nets.select(F.struct("net", F.col("src").alias("id")).alias("src"), F.struct("net", F.col("dst").alias("id")).alias("dst"))
    return clustering_coefficient(keyed).groupBy("node.net").agg(F.avg("cliqueness").alias("cliqueness"))
