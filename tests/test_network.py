import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.operators import clustering, diffusion, enrichment, motifs, network, ontology, paths, random_nets, ranking
from lattica.operators.components import connected_components

BRIDGED = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_drops_self_and_repeats(spark):
    assert rows(network.canonical(edges(spark, [(2, 1), (1, 2), (3, 3), (None, 1)]))) == [(1, 2)]


def test_components_of_random_graphs_match_union_find(spark):
    random.seed(3)
    pairs = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(110)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert dict(rows(connected_components(edges(spark, pairs)))) == {n: find(n) for n in parent}


def test_components_of_nothing(spark):
    assert connected_components(edges(spark, [])).count() == 0


def test_degrees_hubs_and_summary(spark):
    star = edges(spark, [(0, i) for i in range(1, 6)])
    assert dict(rows(network.degrees(star)))[0] == 5
    assert [r[0] for r in rows(network.hubs(star, 0.2).where("is_hub").select("node"))] == [0]
    assert network.without_hubs(star, 0.2).count() == 0
    assert network.degree_summary(star).first()["top_node"] == 0


def test_clustering_coefficient(spark):
    c = {r["node"]: r["cliqueness"] for r in network.clustering_coefficient(edges(spark, BRIDGED + [(6, 7)])).collect()}
    assert c[1] == 1.0 and c[3] == pytest.approx(1 / 3) and c[7] == 1.0


def test_modularity_of_two_triangles(spark):
    parts = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(1, 7)], "node long, cluster string")
    total = network.modularity(edges(spark, BRIDGED), parts).agg(F.sum("modularity")).first()[0]
    assert total == pytest.approx(6 / 7 - 0.5)


def test_distances_and_paths(spark):
    e, s = edges(spark, BRIDGED + [(8, 9)]), spark.createDataFrame([(1,), (77,)], "node long")
    d = {r["node"]: r["distance"] for r in paths.distances(e, s).collect()}
    assert d == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3}
    p = {r["node"]: list(r["path"]) for r in paths.shortest_paths(e, s).collect()}
    assert p[6] == [1, 3, 4, 6] and p[1] == [1]
    assert (3, 4) in {(r["src"], r["dst"]) for r in paths.path_edges(paths.shortest_paths(e, s)).collect()}
    one, two = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(5,), (9,)], "node long")
    assert paths.set_distance(e, one, two).first()["mean_min_distance"] == 3.0


def test_betweenness_matches_all_paths(spark):
    got = dict(rows(motifs.betweenness(edges(spark, BRIDGED))))
    assert got[3] == pytest.approx(6 / 10) and got[4] == pytest.approx(6 / 10) and got[1] == 0
    eb = {(r["src"], r["dst"]): r["betweenness"] for r in motifs.edge_betweenness(edges(spark, BRIDGED)).collect()}
    assert eb[3, 4] == 9
    cl = dict(rows(motifs.betweenness_clusters(edges(spark, BRIDGED), 1 / 7, 1)))
    assert len(set(cl.values())) == 2 and cl[1] == cl[3] != cl[4]


def test_maximal_cliques_match_brute_force(spark):
    random.seed(5)
    pairs = sorted({tuple(sorted(random.sample(range(12), 2))) for _ in range(34)})
    adj = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(12)}
    sets = [c for k in range(2, 12) for c in itertools.combinations(range(12), k) if all(b in adj[a] for a, b in itertools.combinations(c, 2))]
    want = sorted(c for c in sets if len(c) >= 3 and not any(set(c) < set(x) for x in sets))
    assert sorted(tuple(r["members"]) for r in motifs.maximal_cliques(edges(spark, pairs)).collect()) == want


def test_simple_cycles(spark):
    arcs = edges(spark, [(1, 2), (2, 3), (3, 1), (2, 1), (4, 4), (3, 4)])
    assert sorted(tuple(r["cycle"]) for r in motifs.simple_cycles(arcs, 4).collect()) == [(1, 2), (1, 2, 3), (4,)]


def test_cycles_are_not_sought_in_dead_ends(spark):
    """Twelve layers of four have 4 ** 12 walks, none of which comes back."""
    layers = [(4 * i + a, 4 * i + 4 + b) for i in range(12) for a in range(4) for b in range(4)]
    arcs = edges(spark, [*layers, (100, 101), (101, 102), (102, 100), (102, 0), (51, 103), (103, 103)])
    assert sorted(tuple(r["cycle"]) for r in motifs.simple_cycles(arcs).collect()) == [(100, 101, 102), (103,)]
    assert motifs.simple_cycles(edges(spark, layers)).count() == 0


def test_connect_and_grow(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (2, 9), (20, 21)])
    got = rows(motifs.connect(e, spark.createDataFrame([(1,), (4,)], "node long")))
    assert got == [(1, 2), (2, 3), (3, 4)]
    scores = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.1), (4, 0.0)], "node long, score double")
    g = motifs.grow_components(e, scores, spark.createDataFrame([(1,)], "node long"))
    assert [r[1] for r in rows(g)] == [1, 2]


def test_tour_of_a_ring(spark):
    import math

    at = {i: (math.cos(i * math.tau / 20), math.sin(i * math.tau / 20)) for i in range(20)}
    d = spark.createDataFrame([(i, j, math.dist(at[i], at[j])) for i in range(20) for j in range(i)], "dst long, src long, distance double")
    t = motifs.shortest_tour(d.select("src", "dst", "distance"), islands=4)
    assert t.first()["length"] == pytest.approx(20 * math.dist(at[0], at[1]))
    assert motifs.tour_length(t.withColumn("island", F.lit(0)), d.select("src", "dst", "distance")).first()["length"] == pytest.approx(t.first()["length"])


def test_push_obeys_its_bound_and_sums_to_one(spark):
    e = edges(spark, BRIDGED)
    p = diffusion.approximate_pagerank(e, spark.createDataFrame([(1,)], "node long"), 0.2, 1e-3)
    total = p.agg(F.sum("p"), F.sum("residue")).first()
    assert total[0] + total[1] == pytest.approx(1.0)
    assert p.join(network.degrees(e), "node").where("residue / degree >= 0.001").count() == 0
    cut = diffusion.sweep(e, p).where("position = 3").first()
    assert cut["conductance"] == pytest.approx(1 / 7)


def test_pushes_leave_what_the_residue_still_owes(spark):
    """p is the lazy walk's PageRank of what is no longer residue, for every seed, and the residue obeys its bound."""
    random.seed(11)
    pairs = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(70)})
    nodes = sorted({x for p in pairs for x in p})
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in pairs:
        a[at[x], at[y]] = a[at[y], at[x]] = 1.0
    degree = a.sum(axis=0)
    for alpha, epsilon in ((0.2, 1e-3), (4e-4, 1e-4)):
        owed = alpha * np.linalg.inv(np.eye(len(nodes)) - (1 - alpha) * (np.eye(len(nodes)) + a / degree) / 2)
        seeds = spark.createDataFrame([(nodes[0],), (nodes[7],), (10_000,)], "node long")
        got = diffusion.approximate_pagerank(edges(spark, pairs), seeds, alpha, epsilon).collect()
        assert {r["seed"] for r in got} == {nodes[0], nodes[7]}
        for seed in (nodes[0], nodes[7]):
            p, left = np.zeros(len(nodes)), np.zeros(len(nodes))
            for r in got:
                if r["seed"] == seed:
                    p[at[r["node"]]], left[at[r["node"]]] = r["p"], r["residue"]
            start = np.zeros(len(nodes))
            start[at[seed]] = 1.0
            assert p == pytest.approx(owed @ (start - left), abs=1e-9) and (left / degree).max() < epsilon
    with pytest.raises(Exception, match="touches more than"):
        diffusion.approximate_pagerank(edges(spark, pairs), spark.createDataFrame([(nodes[0],)], "node long"), 0.2, 1e-3, most_links=3).count()


def test_heat_kernel_rows_sum_to_one_and_modules(spark):
    e = edges(spark, BRIDGED)
    k = diffusion.heat_kernel(e, network.vertices(e), 0.4)
    assert all(r[1] == pytest.approx(1.0) for r in rows(k.groupBy("source").agg(F.sum("value"))))
    scores = spark.createDataFrame([(i, 1.0 if i < 4 else 0.01) for i in range(1, 7)], "node long, score double")
    weights = diffusion.hot_edges(k, e, scores)
    got = dict(rows(diffusion.hot_modules(weights, weights.where("src = 1 and dst = 2").first()["weight"])))
    assert got[1] == got[2] == 1
    sig = diffusion.module_significance(k, e, scores, 0.05, 4).collect()
    assert all(0 <= r["p_value"] <= 1 and 0 <= r["fdr"] <= 1 for r in sig)


def test_random_networks_keep_what_they_promise(spark):
    pairs = [(i, (i * 7 + k) % 60) for i in range(60) for k in (1, 9)]
    e = network.canonical(edges(spark, pairs))
    swapped = random_nets.switch_edges(e, 2)
    assert rows(network.degrees(swapped)) == rows(network.degrees(e))
    assert swapped.distinct().count() == e.count() and rows(swapped) != rows(e)
    assert random_nets.random_graph(network.vertices(e), 50).distinct().count() == 50
    assert random_nets.random_pairs(network.vertices(e), 30, e).join(e, ["src", "dst"]).count() == 0
    assert random_nets.configuration_model(e).where("src >= dst").count() == 0


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_agglomerate_matches_one_by_one(spark, linkage):
    random.seed(8)
    pts = [random.random() * 100 for _ in range(14)]
    d = {(i, j): abs(pts[i] - pts[j]) for i in range(14) for j in range(14)}
    groups, heights = {i: [i] for i in range(14)}, []
    fold = {"single": min, "complete": max, "average": lambda x: sum(x) / len(x)}[linkage]
    while len(groups) > 1:
        h, a, b = min((fold([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in groups for b in groups if a < b)
        heights.append(h)
        groups[a] += groups.pop(b)
    pairs = spark.createDataFrame([(i, j, d[i, j]) for i in range(14) for j in range(i + 1, 14)], "src long, dst long, distance double")
    got = sorted(r["distance"] for r in clustering.agglomerate(pairs, linkage).collect())
    assert got == pytest.approx(sorted(heights))
    if linkage == "single":
        assert sorted(r["distance"] for r in clustering.spanning_forest(pairs).collect()) == pytest.approx(sorted(heights))


def test_map_groups_near_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10, 0.1 * i]) for i in range(20)], "id long, vector array<double>")
    at = {r["id"]: (r["x"], r["y"]) for r in clustering.SelfOrganisingMap(4, 4, 2).fit(v).assign(v).collect()}
    assert {at[i] for i in range(0, 20, 2)}.isdisjoint({at[i] for i in range(1, 20, 2)})


def test_ontology_with_shared_parent_and_cycle(spark):
    h = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("b", "e")], "child string, parent string")
    root = spark.createDataFrame([("a",)], "root string")
    assert {(r["term"], r["depth"]) for r in ontology.descendants(h, root).collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert ontology.descendants(h, root, recursive=False).count() == 2
    keys = spark.createDataFrame([("k1", "e"), ("k2", "z")], "key string, term string")
    assert [r["key"] for r in ontology.keys_outside(keys, h, root).collect()] == ["k2"]


def test_enrichment_where_every_key_has_the_term(spark):
    ann = spark.createDataFrame([("x", "t"), ("y", "t"), ("x", "u")], "key string, term string")
    got = {r["term"]: r["p_value"] for r in enrichment.enrich(spark.createDataFrame([("x",), ("x",)], "key string"), ann).collect()}
    assert got["t"] == 1.0 and got["u"] == pytest.approx(0.25)


def test_heat_kernels_match_exact_ones(spark):
    e = edges(spark, BRIDGED)
    a = np.zeros((6, 6))
    for x, y in BRIDGED:
        a[x - 1, y - 1] = a[y - 1, x - 1] = 1
    degree = a.sum(axis=1)
    for mode, laplacian in (("random_walk", np.eye(6) - a / degree[:, None]), ("combinatorial", np.diag(degree) - a)):
        exact, term = np.zeros((6, 6)), np.eye(6)
        for k in range(1, 60):
            exact, term = exact + term, term @ (-0.7 * laplacian) / k
        got = {(r[0], r[1]): r[2] for r in diffusion.heat_kernel(e, network.vertices(e), 0.7, mode=mode).collect()}
        for i in range(6):
            for j in range(6):
                assert got.get((i + 1, j + 1), 0.0) == pytest.approx(exact[i, j], abs=1e-7)


def test_running_sums_match_plain_ones_with_one_hot_key(spark):
    random.seed(5)
    rows_ = [("hot" if i % 3 else f"k{i % 7}", random.randint(0, 40), i) for i in range(400)] + [(None, 1, 1000), (None, 2, 1001)]
    df = spark.createDataFrame(rows_, "k string, v long, i long")
    got = {r["i"]: r["s"] for r in ranking.running_sums(df, ["k"], [F.col("v"), F.col("i")], s="v").collect()}
    want, total = {}, {}
    for k, v, i in sorted(rows_, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    assert got == want
    assert ranking.numbered(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_searches_go_to_the_end_of_long_paths(spark):
    n = 66
    chain = edges(spark, [(i, i + 1) for i in range(n)])
    one = spark.createDataFrame([(0,)], "node long")
    assert paths.distances(chain, one).agg(F.max("distance")).first()[0] == n
    assert paths.distances(chain, one, max_depth=3).count() == 4
    goal = spark.createDataFrame([(5,)], "node long")
    assert rows(paths.distances(chain, one, targets=goal)) == [(0, 5, 5)]


def test_large_cliques_and_cycles_are_found(spark):
    k = 9
    clique = edges(spark, list(itertools.combinations(range(k), 2)) + [(0, 100)])
    assert rows(motifs.maximal_cliques(clique).select("size")) == [(k,)]
    ring = edges(spark, [(i, (i + 1) % 12) for i in range(12)])
    assert rows(motifs.simple_cycles(ring).select("length")) == [(12,)]
    assert motifs.simple_cycles(ring, longest=5).count() == 0


def test_grown_components_lose_leaves_that_cost(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (1, 5)])
    scores = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 5.0), (4, 5.0), (5, -3.0)], "node long, score double")
    found = motifs.grow_components(e, scores, spark.createDataFrame([(1,), (3,)], "node long"))
    by = {}
    for s, n, _ in rows(found):
        by.setdefault(s, set()).add(n)
    assert by[3] == {3, 4} and 5 not in by[1]
    assert [r["rank"] for r in motifs.distinct_components(found).orderBy("rank").collect()] == list(range(1, len({frozenset(x) for x in by.values()}) + 1))


def test_keep_degrees_adds_no_edges(spark):
    random.seed(8)
    pairs = sorted({tuple(sorted((random.randint(0, 60), random.randint(0, 60)))) for _ in range(300)})
    pairs = [p for p in pairs if p[0] != p[1]]
    got = random_nets.keep_degrees(edges(spark, pairs)).count()
    assert 0.7 * len(pairs) <= got <= len(pairs)


def test_betweenness_counts_paths_from_all_nodes(spark, monkeypatch):
    """Paths from a few nodes are a sample; counted inside tasks or by joins, links and nodes have what all of them have."""
    rng = random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(0, 40), 2))) for _ in range(50)} | {(100, 101), (101, 102)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want, through = dict.fromkeys(pairs, 0.0), dict.fromkeys(near, 0.0)
    for s in near:
        far, ways, queue = {s: 0}, {s: 1}, [s]
        for x in queue:
            for y in near[x]:
                if y not in far:
                    far[y], ways[y] = far[x] + 1, 0
                    queue.append(y)
                if far[y] == far[x] + 1:
                    ways[y] += ways[x]
        owed = dict.fromkeys(queue, 0.0)
        for y in reversed(queue):
            for x in near[y]:
                if far[x] == far[y] - 1:
                    flow = ways[x] / ways[y] * (1 + owed[y])
                    owed[x] += flow
                    want[min(x, y), max(x, y)] += flow / 2
            if y != s:
                through[y] += owed[y] / 2
    e, n = edges(spark, pairs), len(near)
    for most_links, work in ((10**6, 300), (50, 10**6)):
        monkeypatch.setattr(motifs, "WORK", work)
        got = {(r["src"], r["dst"]): r["betweenness"] for r in motifs.edge_betweenness(e, most_links=most_links).collect()}
        assert got == pytest.approx(want)
    ids = sorted(near)
    a, b = np.array([(ids.index(x), ids.index(y)) for x in ids for y in near[x]]).T
    flows, _ = motifs.travelled(a, b, (np.array(ids) >= 100).astype(int), np.arange(n), most_cells=7)
    assert {(ids[x], ids[y]): f for x, y, f in zip(a, b, flows + flows[np.lexsort((a, b))]) if x < y} == pytest.approx({p: 2 * v for p, v in want.items()})
    got = {r["node"]: r["betweenness"] * (n - 1) * (n - 2) / 2 for r in motifs.betweenness(e).collect()}
    assert got == pytest.approx(through)


def test_the_betweenness_queries_count_from_all_nodes(spark, monkeypatch):
    asked = {}
    for name in ("edge_betweenness", "betweenness"):
        monkeypatch.setattr(queries.motifs, name, lambda e, sources: asked.setdefault("n", (sources.distinct().count(), network.vertices(e).count())) and e.withColumn("betweenness", F.lit(0.0)))
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        nodes, all_nodes = asked.pop("n")
        assert nodes == all_nodes > 10


def test_permuted_modules_equal_plain_counts(spark, monkeypatch):
    """Inside tasks and by joins; places are permutations, and the query takes a thousand of them, not five."""
    for n in (1, 2, 6, 33, 500):
        assert all(sorted(diffusion.permuted_places(np.arange(n), n, p)) == list(range(n)) for p in range(5))
    assert len({tuple(diffusion.permuted_places(np.arange(5), 5, p)) for p in range(2000)}) == 120
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)})
    weight = {p: rng.choice([0.3, 0.1, 0.7]) for p in pairs}
    score = {i: rng.choice([0.3, 0.5, 1 / 3, 0.9, None]) for i in range(44)}
    kernel = spark.createDataFrame([(a, b, w) for (x, y), w in weight.items() for a, b in ((x, y), (y, x))], "source long, node long, value double")
    scores = spark.createDataFrame(list(score.items()), "node long, score double")

    def sizes(value):
        kept = [(a, b) for a, b in pairs if max([s for s in (value[a], value[b]) if s is not None], default=0) * weight[a, b] >= 0.09]
        label = {x: x for p in kept for x in p}
        for _ in label:
            for a, b in kept:
                label[a] = label[b] = min(label[a], label[b])
        return [list(label.values()).count(c) for c in set(label.values())]

    order = sorted(score, key=lambda i: (score[i] is not None, score[i] or 0, i))
    null = [sizes({i: score[order[q]] for i, q in zip(order, diffusion.permuted_places(np.arange(44), 44, p))}) for p in range(70)]
    real = sizes(score)
    many = {s: sum(x >= s for x in real) for s in real}
    want = sorted((s, round(sum(sum(x >= s for x in one) >= many[s] for one in null) / 70, 9)) for s in real)
    for most_links in (10**6, 0):
        got = diffusion.module_significance(kernel, edges(spark, pairs), scores, 0.09, 70, most_links=most_links).collect()
        assert sorted((r["size"], round(r["p_value"], 9)) for r in got) == want
    asked = []
    monkeypatch.setattr(queries, "_hot", lambda *a: (None, None, None))
    monkeypatch.setattr(queries.diffusion, "module_significance", lambda *a: asked.append(a[4]) or spark.createDataFrame([(0.0, 0.0)], "p_value double, fdr double"))
    queries.QUERIES["hot_module_significance"](spark, "/root/testdata/sf0.001")
    assert asked == [1000]
