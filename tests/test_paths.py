import heapq
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from lattica.operators import network, paths, random_nets


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def random_net(seed, n, m):
    rng = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = rng.sample(range(n), 2)
        out.add((min(a, b), max(a, b)))
    return sorted(out)


def links(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def dijkstra(weighted, source):
    near = {}
    for a, b, w in weighted:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, queue = {}, [(0.0, source)]
    while queue:
        d, x = heapq.heappop(queue)
        if x in best:
            continue
        best[x] = d
        for y, w in near[x]:
            if y not in best:
                heapq.heappush(queue, (d + w, y))
    return best


@pytest.mark.parametrize("width", [None, 1.2])
def test_weighted_distances_equal_dijkstra(spark, width):
    rng = random.Random(5)
    pairs = [(a, b, rng.choice([0.25, 0.5, 1.0, 3.0, 7.5])) for a, b in random_net(5, 28, 44)]
    e = spark.createDataFrame([*pairs, (3, 3, 0.1), *[(a, b, w + 1) for a, b, w in pairs[:5]]], "src long, dst long, weight double")
    got = {(r["source"], r["node"]): r["distance"] for r in paths.weighted_distances(e, nodes(spark, [0, 7, 999]), width).collect()}
    want = {(s, n): d for s in (0, 7) for n, d in dijkstra(pairs, s).items()}
    assert got == pytest.approx(want)
    far = {(r["source"], r["node"]) for r in paths.weighted_distances(e, nodes(spark, [0]), farthest=3.0).collect()} if width is None else None
    assert far is None or far == {k for k, d in want.items() if k[0] == 0 and d <= 3.0}


def test_weights_must_be_positive(spark):
    for w in (0.0, -1.0, None):
        with pytest.raises(ValueError):
            paths.weighted_distances(spark.createDataFrame([(1, 2, w)], "src long, dst long, weight double"), nodes(spark, [1]))
    assert paths.weighted_distances(spark.createDataFrame([], "src long, dst long, weight double"), nodes(spark, [1])).count() == 0


def sequential(pairs, source, rank):
    """A queue whose node takes its edges in order of rank."""
    near, parent, order, queue = links(pairs), {source: None}, [source], deque([source])
    while queue:
        x = queue.popleft()
        for y in sorted(near[x], key=lambda y: (rank.get((x, y), float("inf")), y)):
            if y not in parent:
                parent[y] = x
                order.append(y)
                queue.append(y)
    return parent, order


def test_ranked_search_equals_a_queue(spark):
    rng = random.Random(2)
    pairs = random_net(2, 50, 110)
    rank = {(x, y): float(rng.randrange(6)) for a, b in pairs for x, y in ((a, b), (b, a))}
    r = spark.createDataFrame([(x, y, v) for (x, y), v in rank.items()], "node long, neighbour long, rank double")
    got = paths.ranked_search(edges(spark, pairs), nodes(spark, [0, 9]), r).collect()
    for s in (0, 9):
        parent, order = sequential(pairs, s, rank)
        own = [x for x in got if x["source"] == s]
        assert {x["node"]: x["parent"] for x in own} == parent
        assert [x["node"] for x in sorted(own, key=lambda x: (x["level"], x["place"]))] == order


def test_edge_ranks_follow_the_order_of_keys(spark):
    pairs = [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (6, 7)]
    ranks = paths.edge_ranks(edges(spark, pairs), nodes(spark, [3]), edges(spark, [(0, 4)]), spark.createDataFrame([(5, -2.0), (2, 0.5)], "node long, score double"))
    order = [r["neighbour"] for r in ranks.where("node = 0").orderBy("rank").collect()]
    assert order == [4, 3, 5, 2, 1, 6]


def test_spanning_paths_join_the_members(spark):
    pairs = random_net(8, 30, 60)
    members = [3, 11, 17, 29, 77]
    none = spark.createDataFrame([], "node long, score double")
    ranks = paths.edge_ranks(edges(spark, pairs), nodes(spark, members), edges(spark, []), none)
    rank = {(r["node"], r["neighbour"]): r["rank"] for r in ranks.collect()}
    parent, _ = sequential(pairs, 3, rank)
    want = set()
    for m in members:
        while m in parent and parent[m] is not None:
            want.add((min(m, parent[m]), max(m, parent[m])))
            m = parent[m]
    got = {tuple(r) for r in paths.spanning_paths(edges(spark, pairs), nodes(spark, members), ranks).collect()}
    assert got == want


def hops(pairs, source):
    near, out, queue = links(pairs), {source: 0}, deque([source])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in out:
                out[y] = out[x] + 1
                queue.append(y)
    return out


def test_pair_distances_from_both_ends_equal_breadth_first(spark):
    nets = {g: random_net(g, 45, 55) for g in range(3)}
    named = [(g, a, b) for g in nets for a in range(0, 45, 4) for b in range(1, 45, 5)]
    e = spark.createDataFrame([(g, *p) for g, ps in nets.items() for p in ps], "net int, src long, dst long")
    got = {(r["net"], r["src"], r["dst"]): r["distance"] for r in paths.pair_distances(e, spark.createDataFrame(named, "net int, src long, dst long")).collect()}
    assert got == {(g, a, b): hops(nets[g], a).get(b) for g, a, b in named}
    assert None in got.values() and max(d or 0 for d in got.values()) > 4


def test_random_pairs_are_not_sorted_on_the_driver(spark):
    """A sorted limit sends its rows to the driver, and a random network has as many as the network has edges."""
    nodes = spark.range(500).withColumnRenamed("id", "node")
    for n in (1, 300, 100_000):
        drawn = paths.random_pairs(nodes, n, seed="far")
        assert "TakeOrdered" not in drawn._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in drawn.collect()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got) and (len(got) == n or n == 100_000)
    assert set(map(tuple, paths.random_pairs(nodes, 20, seed="far").collect())) != set(map(tuple, paths.random_pairs(nodes, 20, seed="near").collect()))


def test_histograms_over_random_pairs_and_networks(spark):
    pairs = random_net(4, 40, 80)
    got = {r["distance"]: r["pairs"] for r in paths.path_length_histogram(edges(spark, pairs), 100).collect()}
    assert sum(got.values()) == 100
    chosen = [tuple(r) for r in paths.random_pairs(network.vertices(edges(spark, pairs)), 100, seed="pairs").collect()]
    assert got == Counter(hops(pairs, a).get(b) for a, b in chosen)
    rows = paths.random_path_lengths(edges(spark, pairs), 2, 50).groupBy("net").agg(F.sum("pairs").alias("n")).collect()
    assert sorted((r["net"], r["n"]) for r in rows) == [(0, 50), (1, 50)]
    nets = {}
    for r in paths.random_networks(edges(spark, pairs), 3).collect():
        nets.setdefault(r["net"], set()).add((r["src"], r["dst"]))
    assert all(len(n) == 80 for n in nets.values()) and nets[0] != nets[1]
    for r in paths.random_cliqueness(edges(spark, pairs), 3).collect():
        near = links(nets[r["net"]])
        own = [1.0 if len(v) == 1 else 2 * sum(b in near[a] for a in v for b in v if a < b) / (len(v) * (len(v) - 1)) for v in near.values()]
        assert r["cliqueness"] == pytest.approx(sum(own) / len(own))


def jobs_of(spark, work):
    """How many Spark jobs ``work`` takes."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = len(sc.statusTracker().getJobIdsForGroup("counted"))
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_long_ways_take_few_jobs(spark):
    """Searches of a component that fits a task don't take jobs by its depth."""
    line = [(i, i + 1) for i in range(60)]
    e = edges(spark, line)
    ranks = spark.createDataFrame([(0, 1, 1.0)], "node long, neighbour long, rank double")
    found = []
    assert jobs_of(spark, lambda: found.extend(paths.ranked_search(e, nodes(spark, [0]), ranks).collect())) < 200
    assert {r["node"]: r["level"] for r in found} == {i: i for i in range(61)}
    found.clear()
    assert jobs_of(spark, lambda: found.extend(paths.weighted_distances(e.withColumn("weight", F.col("src") + 1.0), nodes(spark, [0])).collect())) < 200
    assert {r["node"]: r["distance"] for r in found} == {i: i * (i + 1) / 2 for i in range(61)}


@pytest.mark.parametrize("text", [False, True])
def test_searches_in_tasks_and_by_joins_agree(spark, text):
    pairs = [*random_net(3, 30, 60), *[(a + 100, b + 100) for a, b in random_net(4, 12, 20)]]
    rng = random.Random(9)
    e = edges(spark, pairs).withColumn("weight", 1.0 + F.pmod(F.col("src") * 3 + F.col("dst"), F.lit(7)))
    ranks = spark.createDataFrame([(x, y, float(rng.randrange(3))) for a, b in pairs for x, y in ((a, b), (b, a)) if rng.random() < 0.8], "node long, neighbour long, rank double")
    own = nodes(spark, [0, 5, 29, 103])
    if text:
        as_text = lambda df, *names: df.withColumns({c: F.col(c).cast("string") for c in names})
        e, ranks, own = as_text(e, "src", "dst"), as_text(ranks, "node", "neighbour"), as_text(own, "node")
    for search in (lambda most: paths.ranked_search(e, own, ranks, most), lambda most: paths.weighted_distances(e, own, most_links=most)):
        all_tasks, mixed, all_joins = (sorted(map(tuple, search(most).collect()), key=str) for most in (10_000, 60, 0))
        assert all_tasks == mixed == all_joins


def test_pairs_apart_are_not_searched(spark):
    line = [(i, i + 1) for i in range(40)] + [(i, i + 1) for i in range(100, 140)]
    e = edges(spark, line).withColumn("net", F.lit(0)).select("net", "src", "dst")
    pairs = spark.createDataFrame([(0, 0, 100), (0, 7, 140), (0, 3, 3), (0, 1, 2), (0, 1, 999)], "net int, src long, dst long")
    found = []
    assert jobs_of(spark, lambda: found.extend(paths.pair_distances(e, pairs).collect())) < 200
    assert {(r["src"], r["dst"]): r["distance"] for r in found} == {(0, 100): None, (7, 140): None, (3, 3): 0, (1, 2): 1, (1, 999): None}


def test_random_networks_bring_no_nodes_or_edges_to_the_driver(spark, monkeypatch):
    """A broadcast goes through the driver; sizes of what was written are guessed far too small for one."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    written = []
    settled = random_nets.settled
    monkeypatch.setattr(random_nets, "settled", lambda df: written.append(plan(df)) or settled(df))
    nodes = spark.range(40).withColumnRenamed("id", "node")
    net = random_nets.random_graph(nodes, 60).localCheckpoint()
    assert net.count() == 60 and len(written) == 1
    random_nets.random_pairs(nodes, 10, net)
    assert not any("Broadcast" in p for p in [*written, plan(network.clustering_coefficient(net))])


def test_weighted_distances_give_targets_only(spark):
    """Of the rows of all nodes an average over a set needs few; the others are not written out by the tasks."""
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(20), 2))) for _ in range(30)})
    e = spark.createDataFrame([(a, b, float(1 + (a * 3 + b) % 7)) for a, b in pairs], "src long, dst long, weight double")
    s, t = (spark.createDataFrame([(i,) for i in ids], "node long") for ids in ((1, 2, 3), (2, 5, 7, 99)))
    every = {tuple(r) for r in paths.weighted_distances(e, s).collect()}
    for most_links in (10**6, 0):
        got = [tuple(r) for r in paths.weighted_distances(e, s, most_links=most_links, targets=t).collect()]
        assert len(got) == len(set(got)) and set(got) == {r for r in every if r[1] in (2, 5, 7)}


def test_weighted_searches_try_links_of_nodes_that_fell_only(monkeypatch):
    """All links for all sources in every round are work that grows with the longest path."""
    tried = []

    class Minimum:
        def at(self, far, cell, distance):
            tried.append(len(cell))
            for c, d in zip(cell, distance):
                far[c] = min(far[c], d)

    ends = [(i, i + 1) for i in range(200)]
    both = ends + [(b, a) for a, b in ends]
    links = paths.pa.table({"node": [a for a, _ in both], "neighbour": [b for _, b in both], "weight": [1.0 + a % 3 for a, _ in both]})
    monkeypatch.setattr(paths.np, "minimum", Minimum())
    got = paths._nearest(links, paths.pa.table({"source": [0, 100]}), None)
    assert sum(tried) == 2 * 200 and got.num_rows == 2 * 201
