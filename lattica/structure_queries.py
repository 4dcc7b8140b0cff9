"""Queries of weighted and ranked paths, random networks, edge removal, cliques, trees of merges, set-valued maps and map files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import clustering, network, paths, peeling, reports
from lattica.queries import ANN, HYP, NET, SQL, _annotation, _brands, _economy, _lchoose, _net, _scores, query, rounded
from lattica.session import settled, shared_path, table
from lattica.sources import annotations, readers, writers

# ---------------------------------------------------------------- paths


def _genes(spark, d):
    """Economy parts, the gene set of these queries."""
    return _economy(spark, d).withColumnRenamed("key", "node")


def _weights(spark, d):
    """The network with weights from 1 to 7."""
    return _net(spark, d).withColumn("weight", (1 + (F.col("src") * 3 + F.col("dst")) % 7).cast("double"))


GENES = """genes AS (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY' AND p_partkey IN (SELECT node FROM deg))"""
WEIGHTED = f"""{NET}, {GENES},
wsym AS (SELECT src AS node, dst AS neighbour, 1 + (src * 3 + dst) % 7 AS w FROM net UNION ALL SELECT dst, src, 1 + (src * 3 + dst) % 7 FROM net),
d(source, node, dist) USING KEY (source, node) AS (SELECT node, node, 0::BIGINT FROM genes UNION
  SELECT x.source, x.node, x.dist FROM (SELECT d.source, s.neighbour AS node, min(d.dist + s.w) AS dist FROM d JOIN wsym s ON s.node = d.node GROUP BY ALL) x
  LEFT JOIN recurring.d k ON k.source = x.source AND k.node = x.node WHERE k.dist IS NULL OR x.dist < k.dist)"""


@query("weighted_distances", f"WITH RECURSIVE {WEIGHTED} SELECT source, node, dist::DOUBLE AS distance FROM d")
def _(spark, d):
    return paths.weighted_distances(_weights(spark, d), _genes(spark, d))


@query("average_weighted_distance", f"WITH RECURSIVE {WEIGHTED} SELECT count(*) AS pairs, round(avg(dist), 8) AS distance FROM d JOIN genes g ON g.node = d.node WHERE d.source < d.node")
def _(spark, d):
    """Mean least distance between economy parts that are connected."""
    genes = _genes(spark, d)
    found = paths.weighted_distances(_weights(spark, d), genes, targets=genes).where("source < node")
    return rounded(found.agg(F.count(F.lit(1)).alias("pairs"), F.avg("distance").alias("distance")), "distance")


def _ranks(spark, d):
    curated = _net(spark, d).where((F.col("src") + F.col("dst")) % 2 == 0)
    return settled(paths.edge_ranks(_net(spark, d), _genes(spark, d), curated, _scores(spark, d)))


EDGE_RANKS = f"""{NET}, {GENES}, top AS (SELECT max(p_retailprice) AS m FROM part),
ranks AS (SELECT s.node, s.neighbour, row_number() OVER (PARTITION BY s.node ORDER BY g.degree, (s.node + s.neighbour) % 2, (e.node IS NULL), p.p_retailprice / top.m DESC, s.neighbour) AS rank
  FROM sym s JOIN deg g ON g.node = s.neighbour JOIN part p ON p.p_partkey = s.neighbour CROSS JOIN top LEFT JOIN (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY') e ON e.node = s.neighbour)"""


@query("edge_ranks", f"WITH {EDGE_RANKS} SELECT node, neighbour, rank::DOUBLE AS rank FROM ranks")
def _(spark, d):
    return _ranks(spark, d)


@query("ranked_search")
def _(spark, d):
    """Trees from every economy part over the whole network."""
    return paths.ranked_search(_net(spark, d), _genes(spark, d), _ranks(spark, d))


@query("spanning_paths")
def _(spark, d):
    return paths.spanning_paths(_net(spark, d), _genes(spark, d), _ranks(spark, d))


def _pairs_sql(name: str, n: str, seed: str, without: str = "") -> str:
    """The SQL of ``random_pairs`` over the nodes ``deg``; ``without`` is a condition on pairs."""
    return f"""{name}_i AS (SELECT node, row_number() OVER (ORDER BY md5('{seed}:' || node), node) AS i FROM deg),
{name}_t AS (SELECT count(*) AS total, greatest(4, ceil(8.0 * ({n}) / count(*)))::BIGINT AS draws FROM deg),
{name}_d AS (SELECT node, unnest(range(1, least(draws, total - 1) + 1)) AS d, total FROM deg, {name}_t),
{name}_p AS (SELECT DISTINCT least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst FROM (SELECT node, ('0x' || substr(md5('{seed}:' || node || ':' || d), 1, 12))::BIGINT % total + 1 AS j FROM {name}_d) a JOIN {name}_i b ON b.i = a.j WHERE a.node <> b.node),
{name} AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY md5('{seed}o:' || src || ':' || dst), src, dst) AS r FROM {name}_p {without}) WHERE r <= ({n}))"""


def _bfs_sql(edges: str, pairs: str, net: str = "0") -> str:
    """Breadth-first distances of pairs in keyed networks, of those that are connected."""
    return f"""both_e AS (SELECT {net} AS net, src AS node, dst AS neighbour FROM {edges} UNION ALL SELECT {net}, dst, src FROM {edges}),
b(net, source, node, dist) AS (SELECT DISTINCT {net}, src, src, 0 FROM {pairs} UNION SELECT b.net, b.source, s.neighbour, b.dist + 1 FROM b JOIN both_e s ON s.node = b.node AND s.net = b.net
  WHERE NOT EXISTS (SELECT 1 FROM recurring.b k WHERE k.net = b.net AND k.source = b.source AND k.node = s.neighbour)),
least_d AS (SELECT net, source, node, min(dist)::INT AS distance FROM b GROUP BY ALL)"""


@query(
    "path_length_histogram",
    f"WITH RECURSIVE {NET}, {_pairs_sql('chosen', '10000', 'pairs')}, {_bfs_sql('net', 'chosen')} SELECT l.distance, count(*) AS pairs FROM chosen c LEFT JOIN least_d l ON l.source = c.src AND l.node = c.dst GROUP BY l.distance",
)
def _(spark, d):
    """Of ten thousand random pairs, as many as that sample takes."""
    return paths.path_length_histogram(_net(spark, d), 10_000)


def _nets_sql(networks: int) -> str:
    m = "SELECT count(*) FROM net"
    made = ", ".join(_pairs_sql(f"r{i}", m, f"net{i}") for i in range(networks))
    return f"{made}, nets AS ({' UNION ALL '.join(f'SELECT {i} AS net, src, dst FROM r{i}' for i in range(networks))})"


def _random_paths_sql(networks: int, n: int) -> str:
    chosen = ", ".join(_pairs_sql(f"c{i}", str(n), f"netp{i}") for i in range(networks))
    every = " UNION ALL ".join(f"SELECT {i} AS net, src, dst FROM c{i}" for i in range(networks))
    return f"WITH RECURSIVE {NET}, {_nets_sql(networks)}, {chosen}, chosen AS ({every}), {_bfs_sql('nets', 'chosen', 'net')} SELECT c.net, l.distance, count(*) AS pairs FROM chosen c LEFT JOIN least_d l ON l.net = c.net AND l.source = c.src AND l.node = c.dst GROUP BY ALL"


@query("random_path_lengths", _random_paths_sql(6, 1000))
def _(spark, d):
    """A thousand pairs in each of six random networks of the same size."""
    return paths.random_path_lengths(_net(spark, d))


@query(
    "random_cliqueness",
    f"""WITH {NET}, {_nets_sql(10)}, s AS (SELECT net, src AS node, dst AS neighbour FROM nets UNION ALL SELECT net, dst, src FROM nets), g AS (SELECT net, node, count(*) AS k FROM s GROUP BY ALL),
t AS (SELECT a.net, a.node, count(*) AS t FROM s a JOIN s b ON a.net = b.net AND a.node = b.node AND a.neighbour < b.neighbour JOIN nets e ON e.net = a.net AND e.src = a.neighbour AND e.dst = b.neighbour GROUP BY ALL)
SELECT g.net, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 2.0 * coalesce(t, 0) / (k * (k - 1)) END), 8) AS cliqueness FROM g LEFT JOIN t ON t.net = g.net AND t.node = g.node GROUP BY g.net""",
)
def _(spark, d):
    return rounded(paths.random_cliqueness(_net(spark, d)), "cliqueness")


# ---------------------------------------------------------------- taking networks apart


@query("best_removal")
def _(spark, d):
    """The cut of most modularity of the network within economy parts, and its clusters."""
    return rounded(peeling.best_removal(network.induced(_net(spark, d), _genes(spark, d))), "modularity")


@query("removal_sweep")
def _(spark, d):
    inner = network.induced(_net(spark, d), _genes(spark, d))
    return rounded(peeling.removal_sweep(inner, peeling.removal_order(inner)), "modularity")


@query("greedy_clique")
def _(spark, d):
    return peeling.greedy_clique(_net(spark, d))


@query("prefix_clique")
def _(spark, d):
    """Parts whose names begin with 'red', and what the whole network adds."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    return peeling.prefix_clique(_net(spark, d), names, "red")


# ---------------------------------------------------------------- trees, maps, files


def _price_merges(spark, d):
    """Merges of a tree: within each brand parts join its smallest one by one, then brands join the smallest of all."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("x"), F.col("p_brand").alias("b"))
    first = settled(p.groupBy("b").agg(F.min("x").alias("m")))
    inner = p.join(first, "b").where("x > m").select(F.col("m").alias("merged"), F.col("m").alias("left"), F.col("x").alias("right"), F.col("x").alias("round"))
    top = first.agg(F.min("m").alias("g"))
    outer = first.crossJoin(F.broadcast(top)).where("m > g").select(F.col("g").alias("merged"), F.col("g").alias("left"), F.col("m").alias("right"), (F.col("m") + 1_000_000_000_000).alias("round"))
    return inner.union(outer)


@query(
    "tree_order",
    """WITH RECURSIVE f AS (SELECT p_brand AS b, min(p_partkey) AS m FROM part GROUP BY p_brand),
m AS (SELECT f.m AS merged, p_partkey AS r, p_partkey AS round FROM part p JOIN f ON f.b = p.p_brand WHERE p_partkey > f.m UNION ALL SELECT (SELECT min(m) FROM f), m, m + 1000000000000 FROM f WHERE m > (SELECT min(m) FROM f)),
k AS (SELECT merged AS node, row_number() OVER (PARTITION BY merged ORDER BY round) AS merge, r FROM m), n AS (SELECT node, max(merge) AS top FROM k GROUP BY node),
c AS (SELECT node, merge, node AS child, merge - 1 AS cm, 0 AS side FROM k UNION ALL SELECT k.node, k.merge, k.r, coalesce(n.top, 0), 1 FROM k LEFT JOIN n ON n.node = k.r),
t(node, merge, path) AS (SELECT node, merge, []::INT[] FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.child = k.node AND c.cm = k.merge) UNION ALL SELECT c.child, c.cm, list_append(t.path, c.side) FROM t JOIN c ON c.node = t.node AND c.merge = t.merge),
s(node, merge, leaf) AS (SELECT node, merge, node FROM t WHERE merge = 0 UNION ALL SELECT c.node, c.merge, s.leaf FROM s JOIN c ON c.child = s.node AND c.cm = s.merge),
z AS (SELECT node, merge, count(*) AS size FROM s GROUP BY ALL)
SELECT node, merge, (SELECT min(node) FROM k) AS root, merge = 0 AS leaf, size, len(path) AS depth, row_number() OVER (ORDER BY path) AS depth_first, row_number() OVER (ORDER BY len(path), path) AS breadth_first FROM t JOIN z USING (node, merge)""",
)
def _(spark, d):
    return clustering.tree_order(_price_merges(spark, d))


@query("set_map")
def _(spark, d):
    """Suppliers as sets of parts on a map of eight by eight."""
    sets = _annotation(spark, d).select(F.col("term").alias("id"), F.col("key").alias("item"))
    return rounded(clustering.SetMap(side=8, rounds=4, width=4).fit(sets).assign(sets), "similarity")


@query("set_map_medians")
def _(spark, d):
    sets = _annotation(spark, d).select(F.col("term").alias("id"), F.col("key").alias("item"))
    return clustering.SetMap(side=8, rounds=4, width=4).fit(sets).medians(sets)


@query(
    "read_map_nodes",
    """SELECT (p_partkey // 100)::INT AS x, (p_partkey % 100)::INT AS y, p_retailprice AS distance, CASE WHEN p_size % 2 = 0 THEN p_brand || ',' || p_type ELSE '' END AS labels, p_size + p_retailprice AS total FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part")
    labels = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    nodes = p.select(F.floor(F.col("p_partkey") / 100).cast("int").alias("x"), (F.col("p_partkey") % 100).cast("int").alias("y"), F.col("p_retailprice").alias("distance"), labels.alias("labels"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("vector"))
    path = shared_path(spark, "map")
    writers.write_map_nodes(nodes, path)
    return readers.map_nodes(spark, path).select("x", "y", "distance", F.array_join("labels", ",").alias("labels"), F.aggregate("vector", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("gene_sentences", "SELECT 'BUILDING'::VARCHAR AS gene, 'customer ' || c_custkey AS statement FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    """Customers as entries of their segment, asked for one segment by named arguments."""
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    sentence = F.struct(F.struct(none.alias("MatchedGeneTerm")).alias("GeneData"), F.struct(none.alias("MatchedDiseaseTerm"), none.alias("NCIDiseaseConceptCode")).alias("DiseaseData"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("Statement"), F.lit("finished").alias("SentenceStatusFlag"))
    entries = c.select(F.col("c_mktsegment").alias("HUGOGeneSymbol"), F.array(sentence).alias("Sentence"))
    return readers.gene_sentences(spark, entries, "BUILDING").select("gene", "statement")


@query("write_components", f"WITH RECURSIVE {NET}, b AS (SELECT p_brand AS c, node FROM part JOIN deg ON p_partkey = node), n AS (SELECT c FROM b GROUP BY c HAVING count(*) >= 4) SELECT c AS component, node::VARCHAR AS node FROM b SEMI JOIN n USING (c)")
def _(spark, d):
    """Brands of four parts of the network and more, a folder each."""
    own = _brands(spark, d).join(network.vertices(_net(spark, d)), "node").select(F.col("cluster").alias("component"), "node")
    path = shared_path(spark, "components")
    writers.write_components(own, path)
    return spark.read.schema("value string, component string").text(path).select("component", F.col("value").alias("node"))


@query("write_gene_scores", "SELECT p_partkey::VARCHAR AS key, p_retailprice AS score FROM part")
def _(spark, d):
    path = shared_path(spark, "scores")
    writers.write_gene_scores(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    v = F.split("value", " ")
    return readers.lines(spark, path).select(v[0].alias("key"), v[1].cast("double").alias("score"))


# ---------------------------------------------------------------- annotation by type, topics from counts


def _annotation_files(spark, d) -> dict[str, str]:
    """Files of all types, made of the tables: suppliers are pathways, brands reactions, types and sizes terms of an ontology."""
    ann, p = _annotation(spark, d), table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    files = {k: shared_path(spark, k) for k in ("pathway", "reaction", "ontology", "ontology_names", "protein_names")}
    writers.write_map(ann.select(F.col("key").cast("string").alias("key"), F.col("term").cast("string").alias("term")), "key", "term", files["pathway"])
    writers.write_map(p.select(key.alias("key"), F.col("p_brand").alias("term")), "key", "term", files["reaction"])
    tab = lambda *c: F.concat_ws("\t", *c).alias("value")
    none = F.lit("")
    terms = F.explode(F.array(F.struct(F.concat(F.lit("T:"), "p_type").alias("t"), F.lit("P").alias("a")), F.struct(F.concat(F.lit("S:"), F.col("p_size").cast("string")).alias("t"), F.lit("F").alias("a"))))
    rows = p.select(F.concat(F.lit("prot"), key).alias("protein"), terms.alias("x"))
    rows.select(tab(F.lit("db"), "protein", none, none, "x.t", none, none, none, "x.a")).write.text(files["ontology"])
    named = rows.select("x.t").distinct().where("t <> 'S:7'")
    named.select(tab("t", F.concat(F.lit("name of "), "t"))).write.text(files["ontology_names"])
    genes = p.where("p_partkey % 10 <> 3").select(F.concat(F.lit("prot"), key).alias("protein"), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string").alias("gene"))
    genes.select(tab("protein", "gene")).write.text(files["protein_names"])
    return files


GENE_OF = "(p_partkey - p_partkey % 2)::VARCHAR AS key"
TYPES = f"""{ANN}, t AS (SELECT key::VARCHAR AS key, term::VARCHAR AS term, 'pathway' AS type FROM ann UNION ALL SELECT DISTINCT p_partkey::VARCHAR, p_brand, 'reaction' FROM part
UNION ALL SELECT DISTINCT {GENE_OF}, 'name of T:' || p_type, 'BP' FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT DISTINCT {GENE_OF}, 'name of S:' || p_size, 'MF' FROM part WHERE p_partkey % 10 <> 3 AND p_size <> 7)"""


@query("annotations_by_type", f"WITH {TYPES} SELECT key, term, type FROM t")
def _(spark, d):
    return annotations.all_annotations(spark, _annotation_files(spark, d))


@query("annotation_sizes_by_type", f"WITH {TYPES} SELECT type, term, count(DISTINCT key) AS keys FROM t WHERE type IN ('BP', 'reaction') GROUP BY ALL")
def _(spark, d):
    files = _annotation_files(spark, d)
    both = [annotations.annotation_of_type(spark, files, k).withColumn("type", F.lit(k)) for k in ("BP", "reaction")]
    return both[0].union(both[1]).groupBy("type", "term").agg(F.count_distinct("key").alias("keys"))


@query(
    "topic_tails_from_counts",
    f"""WITH {ANN}, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part), sz AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster HAVING count(*) >= 9), m AS (SELECT term, count(*) AS in_term FROM ann GROUP BY term),
b AS (SELECT cluster, term, count(*) AS hits FROM c JOIN ann ON node = key GROUP BY ALL), tot AS (SELECT 5000 AS total)
SELECT cluster, term::VARCHAR AS term, hits, round({HYP.format(_lchoose("in_term", "i"), _lchoose("(total - in_term)", "(size - i)"), _lchoose("total", "size"))}, 8) AS p_value FROM b JOIN sz USING (cluster) JOIN m USING (term), tot""",
)
def _(spark, d):
    """Brands and suppliers through count files."""
    ann, brands = _annotation(spark, d), _brands(spark, d)
    paths_ = [shared_path(spark, x) for x in ("overlaps", "clusters", "topics")]
    line = lambda *c: F.concat_ws("\t", *[F.col(x).cast("string") for x in c]).alias("value")
    head = spark.range(1).select(F.lit("name\tmembers\ttopic").alias("value"))
    both = brands.join(ann.withColumnRenamed("key", "node"), "node").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    head.union(both.select(line("cluster", "n", "term"))).write.text(paths_[0])
    head.union(brands.groupBy("cluster").count().select(line("cluster", "count"))).write.text(paths_[1])
    head.union(ann.groupBy("term").count().select(line("term", "count"))).write.text(paths_[2])
    overlaps = annotations.counts(spark, paths_[0]).select(F.col("first").alias("cluster"), F.col("last").alias("term"), F.col("n").alias("hits"))
    sizes, topics = (annotations.counts(spark, p) for p in paths_[1:])
    return rounded(reports.topic_tails(overlaps, sizes.select(F.col("first").alias("cluster"), "n"), topics.select(F.col("first").alias("term"), "n"), 5000), "p_value")


@query("topics_of_members", "WITH s AS (SELECT p_brand AS cluster, count(*) AS size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (p_type <> 'SMALL') AS topics FROM part GROUP BY p_brand) SELECT p_partkey AS node, cluster, size, coalesce(topics, '') AS topics FROM part JOIN s ON cluster = p_brand WHERE p_type = 'ECONOMY'")
def _(spark, d):
    topics = table(spark, d, "part").where("p_type <> 'SMALL'").select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("term")).distinct()
    return reports.topics_of_members(_brands(spark, d), topics, _genes(spark, d)).withColumn("topics", F.array_join("topics", ","))


# ---------------------------------------------------------------- SQL of earlier queries

_SEARCH = f"""{NET}, b(source, node, dist) AS (SELECT node, node, 0 FROM few UNION SELECT b.source, s.neighbour, b.dist + 1 FROM b JOIN sym s ON s.node = b.node WHERE NOT EXISTS (SELECT 1 FROM recurring.b k WHERE k.source = b.source AND k.node = s.neighbour)),
least_d AS (SELECT source, node, min(dist)::INT AS distance FROM b GROUP BY ALL)"""
_PATHS = f"""{_SEARCH}, par AS (SELECT x.source, x.node, min(y.node) AS parent FROM least_d x JOIN sym s ON s.node = x.node JOIN least_d y ON y.source = x.source AND y.node = s.neighbour AND y.distance = x.distance - 1 GROUP BY ALL),
way(source, node, path) AS (SELECT node, node, [node] FROM few UNION ALL SELECT par.source, par.node, list_append(way.path, par.node) FROM way JOIN par ON par.source = way.source AND par.parent = way.node)"""

SQL["shortest_paths"] = f"WITH RECURSIVE {_PATHS} SELECT source, node, array_to_string(path, ',') AS path FROM way"
SQL["path_edges"] = f"WITH RECURSIVE {_PATHS}, e AS (SELECT source, node, path, unnest(range(1, len(path))) AS i FROM way) SELECT source, node, least(path[i], path[i + 1]) AS src, greatest(path[i], path[i + 1]) AS dst FROM e"
SQL["set_distance"] = f"""WITH RECURSIVE {_SEARCH}, t AS (SELECT source, l.node, distance FROM least_d l JOIN part ON p_partkey = l.node WHERE p_type = 'ECONOMY'),
m AS (SELECT min(distance) AS m FROM t GROUP BY source UNION ALL SELECT min(distance) FROM t GROUP BY node) SELECT (SELECT round(avg(m), 8) FROM m) AS mean_min_distance, round(avg(distance), 8) AS mean_distance, count(*) AS pairs FROM t"""
SQL["random_graph"] = f"WITH {NET}, {_pairs_sql('made', 'SELECT count(*) FROM net', 'g')} SELECT src, dst FROM made"
SQL["random_pairs"] = f"WITH {NET}, {_pairs_sql('made', '1000', 'r', 'p WHERE NOT EXISTS (SELECT 1 FROM net WHERE net.src = p.src AND net.dst = p.dst)')} SELECT src, dst FROM made"
SQL["random_keep_degrees"] = f"""WITH {NET}, e AS (SELECT src, dst, substr(md5('k:' || src || ':' || dst), 1, 1) < '8' AS first FROM net),
a AS (SELECT row_number() OVER (ORDER BY md5('ka:' || src || ':' || dst)) AS i, CASE WHEN first THEN src ELSE dst END AS x FROM e), b AS (SELECT row_number() OVER (ORDER BY md5('kb:' || src || ':' || dst)) AS i, CASE WHEN first THEN dst ELSE src END AS y FROM e)
SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM a JOIN b USING (i) WHERE x <> y"""
