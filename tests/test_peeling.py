import random
from collections import deque

import pytest

from lattica.operators import network, peeling


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def random_net(seed, n, m, blocks=1):
    rng = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = rng.sample(range(n), 2)
        if a % blocks == b % blocks or rng.random() < 0.08:
            out.add((min(a, b), max(a, b)))
    return sorted(out)


def links(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def plain_betweenness(pairs):
    near, out = links(pairs), dict.fromkeys(pairs, 0.0)
    for s in near:
        order, dist, paths, queue = [], {s: 0}, {s: 1.0}, deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in near[x]:
                if y not in dist:
                    dist[y], paths[y] = dist[x] + 1, 0.0
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    f = paths[x] / paths[y] * (1 + delta[y])
                    out[min(x, y), max(x, y)] += f / 2
                    delta[x] += f
    return out


def plain_removals(pairs, most):
    left, order = list(pairs), []
    for _ in range(most):
        b = plain_betweenness(left)
        e = max(left, key=lambda p: (round(b[p], 9), -p[0], -p[1]))
        left.remove(e)
        order.append(e)
    return order


def clusters_of(nodes, pairs):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def quality(pairs, cluster):
    m, q = len(pairs), 0.0
    for c in set(cluster.values()):
        q += sum(cluster[a] == c == cluster[b] for a, b in pairs) / m - (sum((cluster[a] == c) + (cluster[b] == c) for a, b in pairs) / (2 * m)) ** 2
    return q


def test_removals_inside_a_task_equal_one_by_one(spark):
    pairs = random_net(3, 26, 40, blocks=3)
    got = [(r["src"], r["dst"]) for r in peeling.removal_order(edges(spark, pairs), 0.5).orderBy("place").collect()]
    want = plain_removals(pairs, 20)
    assert len(got) == 20 and set(got) == set(want)
    ids = lambda order: [round(plain_betweenness([p for p in pairs if p not in order[:i]])[p], 6) for i, p in enumerate(order)]
    assert ids(got) == ids(want)  # equal ones may come in another order


def test_best_cut_equals_trying_all(spark):
    pairs = random_net(6, 30, 60, blocks=3)
    removals = peeling.settled(peeling.removal_order(edges(spark, pairs), 0.3))
    order = {(r["src"], r["dst"]): r["place"] for r in removals.collect()}
    nodes = {x for p in pairs for x in p}
    tried = {}
    for cut in sorted({int(60 * i / 200 + 1e-9) for i in range(61)}):
        tried[cut] = quality(pairs, clusters_of(nodes, [p for p in pairs if order.get(p, 99) > cut]))
    swept = {r["removed"]: r["modularity"] for r in peeling.removal_sweep(edges(spark, pairs), removals).collect()}
    assert swept == pytest.approx(tried)
    best = peeling.best_removal(edges(spark, pairs)).collect()
    top = max(tried.values())
    assert {r["removed"] for r in best} == {min(c for c, q in tried.items() if q > top - 1e-9)}
    assert {r["node"]: r["cluster"] for r in best} == clusters_of(nodes, [p for p in pairs if order.get(p, 99) > best[0]["removed"]])


def test_batches_are_not_sorted_on_the_driver(spark, monkeypatch):
    """A sorted limit sends a batch, a share of all edges, to the driver."""
    pairs = [(i, i + 1) for i in range(12)]
    e = edges(spark, pairs)

    limit = type(e).limit

    def one_row_at_most(self, n):
        assert n <= 1
        return limit(self, n)

    monkeypatch.setattr(type(e), "limit", one_row_at_most)
    got = [tuple(r) for r in peeling.removal_order(e, 0.3, largest=5, rounds=2).orderBy("place").select("src", "dst").collect()]
    assert got[0] in ((5, 6), (6, 7)) and len(got) == 3


def test_components_are_worked_off_once_in_a_fixed_number_of_tasks(spark, monkeypatch):
    """Numbering reads its rows twice, and adaptive execution puts small shuffled components into one task."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    numbered, settled, read, written = peeling.numbered, peeling.settled, [], []
    monkeypatch.setattr(peeling, "numbered", lambda df, *a, **k: read.append(plan(df)) or numbered(df, *a, **k))
    monkeypatch.setattr(peeling, "settled", lambda df, *a: written.append(plan(df)) or settled(df, *a))
    pairs = [(10 * i + a, 10 * i + b) for i in range(20) for a, b in ((0, 1), (1, 2), (2, 3), (0, 3), (3, 4))]
    got = [(r["src"], r["dst"]) for r in peeling.removal_order(edges(spark, pairs), 0.2).orderBy("place").collect()]
    assert got == [(10 * i + 3, 10 * i + 4) for i in range(20)]
    work = [p for p in written if "FlatMapGroupsIn" in p]
    assert len(work) == 1 and "REPARTITION_BY_NUM" in work[0]
    assert not any("FlatMapGroupsIn" in p for p in read)


def test_large_components_go_in_batches(spark):
    pairs = random_net(3, 26, 40, blocks=3)
    got = peeling.removal_order(edges(spark, pairs), 0.15, largest=5, rounds=2).orderBy("place").collect()
    b = plain_betweenness(pairs)
    first = sorted(pairs, key=lambda p: (-round(b[p], 9), p))[:3]
    assert [(r["src"], r["dst"]) for r in got][:3] == first and len(got) == 6


def plain_clique(pairs):
    have = set(pairs)
    ids = sorted({x for p in pairs for x in p})
    current = set(pairs)
    while True:
        near = links(current)
        ids = [i for i in ids if i in near]
        gone = None
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (a, b) not in current:
                    gone = a if len(near[a]) < len(near[b]) else b
                    break
            if gone is not None:
                break
        if gone is None:
            return ids
        ids.remove(gone)
        current = {p for p in have if p[0] in ids and p[1] in ids}
        if not current:
            return ids


@pytest.mark.parametrize("seed", range(8))
def test_greedy_clique_equals_the_sequential_rule(seed):
    pairs = random_net(seed, 24, 60 + 10 * seed)
    ids = sorted({x for p in pairs for x in p})
    at = {n: i for i, n in enumerate(ids)}
    got = peeling._dropped(peeling.np.array(ids), *(peeling.np.array([at[p[k]] for p in pairs]) for k in (0, 1)))
    assert [ids[i] for i in got] == plain_clique(pairs)


def test_greedy_clique_by_joins_equals_the_sequential_rule(spark):
    for seed in (1, 4):
        pairs = random_net(seed, 16, 50)
        want = plain_clique(pairs)
        for most in (0, 30, 1000):
            assert sorted(r["node"] for r in peeling.greedy_clique(edges(spark, pairs), most).collect()) == want
    assert peeling.greedy_clique(edges(spark, [])).count() == 0


def test_prefix_clique_grows_in_the_whole_network(spark):
    pairs = [(1, 2), (1, 3), (2, 3), (1, 9), (2, 9), (3, 9), (3, 4), (9, 10)]
    names = spark.createDataFrame([(1, "ZA"), (2, "ZB"), (3, "ZC"), (4, "ZD"), (9, "other"), (10, None)], "node long, name string")
    got = {r["node"]: r["added"] for r in peeling.prefix_clique(edges(spark, pairs), names, "Z").collect()}
    assert got == {1: False, 2: False, 3: False, 9: True}
    assert network.vertices(edges(spark, pairs)).count() == 6


def test_the_size_of_a_component_does_not_change_the_order(spark):
    """Inside a task and by joins edges go one at a time; components over 300 nodes went in ten batches."""
    pairs = random_net(3, 14, 20, blocks=2)
    order = lambda p, **k: [(r["src"], r["dst"]) for r in peeling.removal_order(edges(spark, p), 0.3, **k).orderBy("place").collect()]
    assert order(pairs, most_edges=5) == order(pairs) == plain_removals(pairs, 6)
    long = [(i, i + 1) for i in range(320)]
    got = order(long)
    assert got == [tuple(map(int, r[:2])) for r in peeling._one_by_one(*peeling.np.array(long).T, 96)]
    assert got[0] == (159, 160) or got[0] == (160, 161)
    assert got[1:3] == [(240, 241), (80, 81)] or set(got[1:3]) & {(79, 80), (80, 81), (239, 240), (240, 241)}


def test_pieces_are_counted_alike_dense_or_not(monkeypatch):
    pairs = random_net(9, 60, 90)
    ends = peeling.np.array(pairs).T
    dense = peeling._one_by_one(*ends, 27)
    monkeypatch.setattr(peeling, "DENSE", 5)
    assert peeling._one_by_one(*ends, 27) == dense and [tuple(map(int, r[:2])) for r in dense] == plain_removals(pairs, 27)
