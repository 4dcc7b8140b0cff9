import math
import random

import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.operators import clustering, diffusion
from lattica.sources import readers, writers


def plain_tree(merges):
    """Trees of merges in order, walked by recursion."""
    now, child, count = {}, {}, {}
    for x, y in merges:
        left, right = now.get(x, (x, 0)), now.get(y, (y, 0))
        count[x] = count.get(x, 0) + 1
        now[x] = (x, count[x])
        child[now[x]] = (left, right)
        now.pop(y, None)
    out = {}
    below = {c for pair in child.values() for c in pair}
    for root in (n for n in child if n not in below):
        order = []

        def walk(n, depth):
            at = len(order)
            order.append(n)
            leaves = 1 if n not in child else sum(walk(c, depth + 1) for c in child[n])
            out[n] = [root[0], n not in child, leaves, depth, at + 1]
            return leaves

        walk(root, 0)
        for i, n in enumerate(sorted(order, key=lambda n: (out[n][3], out[n][4]))):
            out[n].append(i + 1)
    return {n: tuple(v) for n, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_order_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    alive, merges = list(range(23)), []
    while len(alive) > (1 if seed < 3 else 4):
        x, y = sorted(rng.sample(alive, 2) if seed != 2 else (alive[0], alive[1]))
        merges.append((x, y))
        alive.remove(y)
    df = spark.createDataFrame([(x, x, y, i) for i, (x, y) in enumerate(merges)], "merged long, left long, right long, round int")
    got = {(r["node"], r["merge"]): (r["root"], r["leaf"], r["size"], r["depth"], r["depth_first"], r["breadth_first"]) for r in clustering.tree_order(df).collect()}
    assert got == plain_tree(merges)


def test_tree_order_of_agglomerated_pairs(spark):
    rng = random.Random(4)
    at = [rng.random() for _ in range(12)]
    d = spark.createDataFrame([(i, j, abs(at[i] - at[j])) for i in range(12) for j in range(i)], "src long, dst long, distance double")
    t = clustering.tree_order(clustering.agglomerate(d, "average"))
    assert t.count() == 23 and t.where("leaf").count() == 12 and t.where("depth = 0").first()["size"] == 12
    assert clustering.tree_order(clustering.agglomerate(d.limit(0), "average")).count() == 0


def plain_matched(sets, held, side):
    sim = lambda a, b: len(a & b) / min(len(a), len(b))
    out = {}
    spare = min([n for n in range(side * side) if not held.get(n)], default=0)
    for i, s in sets.items():
        best = max(((round(sum(sim(s, h) for h in own) / len(own), 9), -n) for n, own in held.items() if own), default=(0.0, 0))
        out[i] = (-best[1], best[0]) if best[0] > 0 else (spare, 0.0)
    return out


def test_set_map_equals_a_plain_run(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(20 * (i % 3), 20 * (i % 3) + 22), rng.randrange(1, 9))) for i in range(60)} | {99: {1000}}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] * 2, "id long, item long")
    m = clustering.SetMap(side=4, rounds=3, width=2)
    start = m._first(df.distinct(), max(1, len(set().union(*sets.values())) // len(sets)))
    held = {}
    for r in start.collect():
        held.setdefault(r["node"], set()).add(r["item"])
    held = {n: [s] for n, s in held.items()}
    for step in range(3):
        width = int(2 * (1 - (step + 1) / 3))
        at = plain_matched(sets, held, 4)
        held = {}
        for i, (n, _) in at.items():
            for x in range(max(0, n // 4 - width), min(3, n // 4 + width) + 1):
                for y in range(max(0, n % 4 - width), min(3, n % 4 + width) + 1):
                    held.setdefault(x * 4 + y, []).append(sets[i])
    want = plain_matched(sets, held, 4)
    m.fit(df)
    got = {r["id"]: (r["x"] * 4 + r["y"], r["similarity"]) for r in m.assign(df).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert {i: s for i, (_, s) in got.items()} == pytest.approx({i: s for i, (_, s) in want.items()})
    by = {}
    for i, (n, _) in want.items():
        by.setdefault(n, []).append((len(sets[i]), i))
    middle = {n: sorted(v)[len(v) // 2] for n, v in by.items()}
    assert {r["x"] * 4 + r["y"]: (r["size"], r["id"]) for r in m.medians(df).collect()} == middle


def test_set_map_of_nothing(spark):
    none = spark.createDataFrame([], "id long, item long")
    m = clustering.SetMap(side=2).fit(none)
    assert m.assign(none).count() == 0 and m.medians(none).count() == 0


def test_map_files_round_trip(spark, tmp_path):
    rows = [(x, y, x + y / 10, [f"p{x}", f"q {y}"] if (x + y) % 3 else [], [x / 7, -1.5, 1e-7]) for x in range(6) for y in range(5)]
    nodes = spark.createDataFrame(rows, "x int, y int, distance double, labels array<string>, vector array<double>")
    path = str(tmp_path / "map")
    writers.write_map_nodes(nodes, path)
    assert sorted(map(tuple, readers.map_nodes(spark, path).collect())) == sorted(map(tuple, nodes.collect()))
    text = next((tmp_path / "map").glob("part-*")).read_text()
    assert text.startswith("SOM results:\nlocation:0, 0\nindex:0.0\nvector:")
    other = tmp_path / "with_log.txt"
    other.write_text("label:not a node\nlocation:9, 9\n" + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        split = readers.map_nodes(spark, str(other))
        assert spark.read.text(str(other)).rdd.getNumPartitions() > 3
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, nodes.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sentences_of_a_gene_by_named_arguments(spark, tmp_path):
    xml = """<GeneEntryCollection>
    <GeneEntry><HUGOGeneSymbol>G1</HUGOGeneSymbol>
      <Sentence><DiseaseData><MatchedDiseaseTerm>d1</MatchedDiseaseTerm><NCIDiseaseConceptCode>C1</NCIDiseaseConceptCode></DiseaseData><Statement>s1</Statement><SentenceStatusFlag>finished</SentenceStatusFlag></Sentence>
      <Sentence><DiseaseData><MatchedDiseaseTerm>d2</MatchedDiseaseTerm></DiseaseData><Statement>s2</Statement><SentenceStatusFlag>no_fact</SentenceStatusFlag></Sentence></GeneEntry>
    <GeneEntry><HUGOGeneSymbol>' OR '1'='1</HUGOGeneSymbol></GeneEntry></GeneEntryCollection>"""
    (tmp_path / "g.xml").write_text(xml)
    entries = readers.xml_entries(spark, str(tmp_path / "g.xml"), "GeneEntry", readers.GENE_DISEASE)
    assert [tuple(r) for r in readers.gene_sentences(spark, entries, "G1").collect()] == [("G1", "d1", "C1", "s1")]
    assert readers.gene_sentences(spark, entries, "G1", "NO_FACT").first()["statement"] == "s2"
    assert readers.gene_sentences(spark, entries, "' OR '1'='1").count() == 0


def test_component_and_score_files(spark, tmp_path):
    m = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 9)], "component string, node long")
    writers.write_components(m, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "c")).groupBy("component").agg(F.count("value")).collect()] == [("a", 4)]
    writers.write_gene_scores(spark.createDataFrame([("g1", 3, 0.5)], "gene string, n int, score double"), str(tmp_path / "s"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["g1 0.5"]


def test_spanning_forest_equals_kruskal(spark):
    """Equal distances go by the ids; a link of a node to itself is in no forest."""
    rng = random.Random(8)
    pairs = [(a, b, float(rng.randrange(4))) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08] + [(100, 101, 1.0), (5, 5, 0.0)]
    root = {x: x for p in pairs for x in p[:2]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, d))
    got = clustering.spanning_forest(spark.createDataFrame(pairs, "src long, dst long, distance double")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_tokens_parted_by_document_stay_until_they_meet_their_terms(spark, monkeypatch):
    """Each deal of the tokens moves a row a document and term; by document they lie together from the first."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    settled, plans = clustering.settled, []
    monkeypatch.setattr(clustering, "settled", lambda df, *a: plans.append(plan(df)) or settled(df, *a))
    rows = [(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "c", 1), (None, "a", 1)]
    tokens = spark.createDataFrame(rows, "doc long, term string, n long").repartition("doc")
    got = clustering.tf_idf(tokens)
    assert sum(p.count("Exchange hashpartitioning(doc") for p in plans) == 1  # the test's own
    weights = {(r["doc"], r["term"]): r["weight"] for r in got.collect()}
    assert weights == pytest.approx({(1, "a"): 0.0, (1, "b"): 0.5 * math.log10(2), (2, "a"): 0.0, (2, "c"): 0.5 * math.log10(2)})


def test_permuted_modules_are_named_by_number_and_counted_by_size(spark, monkeypatch):
    """Names as padded text make every round of the components carry text; sizes met module by module are far more rows than sizes."""
    components, types = diffusion.connected_components, []
    monkeypatch.setattr(diffusion, "connected_components", lambda e: types.append(dict(e.dtypes)["src"]) or components(e))
    net = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src long, dst long")
    kernel = spark.createDataFrame([(a, b, 1.0) for x, y in ((1, 2), (2, 3), (4, 5)) for a, b in ((x, y), (y, x))], "source long, node long, value double")
    scores = spark.createDataFrame([(i, 1.0) for i in range(1, 6)], "node long, score double")
    got = diffusion.module_significance(kernel, net, scores, 0.5, 2)
    assert types == ["bigint", "struct<perm:int,id:bigint>"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1.0, 1.0), (4, 2, 1.0, 1.0)]
    assert diffusion.module_significance(kernel, net, scores.where("node < 4"), 0.5, 2).count() == 1


def test_the_network_is_built_once_for_a_search(spark, monkeypatch):
    net, built = queries._net, []
    monkeypatch.setattr(queries, "_net", lambda *a: built.append(a) or net(*a))
    for name in ("edge_betweenness", "betweenness"):
        monkeypatch.setattr(queries.motifs, name, lambda e, sources: e.join(sources, e["src"] == sources["node"]).select(F.lit(0.0).alias("betweenness")))
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(built) == 1
        built.clear()
