"""Queries over the test tables, one for each operator, with the SQL that must give the same rows.

The network links parts that share an order in large quantities; annotation is part to supplier; clusters are brands;
an expression matrix is user by event type; a mutation table is supplier by part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import special as sp
from lattica.functions import stats as st
from lattica.operators import clustering, components, diffusion, enrichment, expression, modularity, motifs, mutation, network, ontology, paths, random_nets
from lattica.session import cut, settled, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Floating sums differ in their last digits from engine to engine."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# ---------------------------------------------------------------- fixtures


def _net(spark, d, least=45) -> DataFrame:
    items = table(spark, d, "lineitem").where(F.col("l_quantity") >= least).select("l_orderkey", "l_partkey")
    return settled(network.co_occurrence(items, "l_orderkey", "l_partkey"))  # operators read it more than once


def _annotation(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("term")).distinct()


def _economy(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("key"))


def _brands(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))


def _matrix(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("feature"), F.col("event_type").alias("sample")).agg(F.avg("value").alias("value"))


def _days(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("feature"), F.to_date("ts").cast("string").alias("sample")).agg(F.avg("value").alias("value"))


def _monthly(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.date_format("l_shipdate", "yyyy-MM").alias("sample")).agg(F.avg("l_quantity").alias("value"))


def _maf(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("position"), F.col("l_extendedprice").alias("score"))


def _scores(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    top = p.agg(F.max("p_retailprice").alias("m"))
    return p.crossJoin(F.broadcast(top)).select(F.col("p_partkey").alias("node"), (F.col("p_retailprice") / F.col("m")).alias("score"))


def _centred_scores(spark, d) -> DataFrame:
    """Prices as deviations from their mean, so that about half of the parts lower a sum."""
    p = table(spark, d, "part")
    m = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    return p.crossJoin(F.broadcast(m)).select(F.col("p_partkey").alias("node"), F.round((F.col("p_retailprice") - F.col("m")) / F.col("s"), 6).alias("score"))


def _few(spark, d, n: int = 10) -> DataFrame:
    """The ``n`` parts of most links: the sources of searches."""
    return network.degrees(_net(spark, d)).orderBy(F.desc("degree"), "node").limit(n).select("node")


NET = """f AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 45),
net AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM f a JOIN f b ON a.o = b.o AND a.p < b.p),
sym AS (SELECT src AS node, dst AS neighbour FROM net UNION ALL SELECT dst, src FROM net),
deg AS (SELECT node, count(*) AS degree FROM sym GROUP BY node),
few AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 10)"""
ANN = """ann AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS term FROM lineitem WHERE l_quantity >= 45)"""
MAT = """mat AS (SELECT user_id AS feature, event_type AS sample, avg(value) AS value FROM events GROUP BY ALL)"""
DAYS = """days AS (SELECT event_type AS feature, strftime(ts, '%Y-%m-%d') AS sample, avg(value) AS value FROM events GROUP BY ALL)"""
LF = "lgamma({} + 1)"


def _lchoose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma(({n}) - ({k}) + 1))"


# ---------------------------------------------------------------- networks


@query("network_edges", f"WITH {NET} SELECT src, dst, src || chr(9) || dst AS key FROM net")
def _(spark, d):
    return _net(spark, d).select("src", "dst", network.edge_key(F.col("src"), F.col("dst")).alias("key"))


@query("network_vertices", f"WITH {NET} SELECT DISTINCT node FROM sym")
def _(spark, d):
    return network.vertices(_net(spark, d))


@query("network_adjacency", f"WITH {NET} SELECT node, string_agg(neighbour::VARCHAR, ',' ORDER BY neighbour) AS neighbours FROM sym GROUP BY node")
def _(spark, d):
    return network.adjacency(_net(spark, d)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query("network_degree", f"WITH {NET} SELECT node, degree FROM deg")
def _(spark, d):
    return network.degrees(_net(spark, d))


@query("degree_histogram", f"WITH {NET} SELECT degree, count(*) AS nodes FROM deg GROUP BY degree")
def _(spark, d):
    return network.degree_histogram(_net(spark, d))


@query("degree_summary", f"WITH {NET} SELECT (sum(degree) / 2)::BIGINT AS edges, count(*) AS nodes, round(avg(degree), 8) AS mean_degree, max(degree) AS max_degree, (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1) AS top_node FROM deg")
def _(spark, d):
    return rounded(network.degree_summary(_net(spark, d)), "mean_degree")


@query("hubs", f"WITH {NET} SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) <= floor(0.05 * count(*) OVER ()) AS is_hub FROM deg")
def _(spark, d):
    return network.hubs(_net(spark, d))


@query("network_without_hubs", f"WITH {NET}, h AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY degree DESC, node) <= floor(0.01 * count(*) OVER ()) AS is_hub FROM deg) x WHERE is_hub) SELECT src, dst FROM net WHERE src NOT IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h)")
def _(spark, d):
    return network.without_hubs(_net(spark, d))


@query("hub_thresholds", f"WITH {NET}, e AS (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY') SELECT k::INT AS threshold, count(*) FILTER (degree > k) AS hubs, count(*) FILTER (degree > k AND node IN (SELECT node FROM e)) AS marked FROM deg, range(1, 41) t(k) GROUP BY k")
def _(spark, d):
    deg = network.degrees(_net(spark, d))
    marked = deg.join(_economy(spark, d).select(F.col("key").alias("node"), F.lit(1).alias("m")), "node", "left").groupBy("degree").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("m"))
    steps = spark.range(1, 41).select(F.col("id").cast("int").alias("threshold"))
    over = steps.join(F.broadcast(marked), F.col("degree") > F.col("threshold"), "left").groupBy("threshold")
    return over.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hubs"), F.coalesce(F.sum("m"), F.lit(0)).alias("marked"))


@query("incident_edges", f"WITH {NET}, e AS (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY') SELECT src, dst FROM net WHERE src IN (SELECT node FROM e) OR dst IN (SELECT node FROM e)")
def _(spark, d):
    return network.incident(_net(spark, d), _economy(spark, d).withColumnRenamed("key", "node"))


@query("induced_network", f"WITH {NET}, e AS (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY') SELECT src, dst FROM net WHERE src IN (SELECT node FROM e) AND dst IN (SELECT node FROM e)")
def _(spark, d):
    return network.induced(_net(spark, d), _economy(spark, d).withColumnRenamed("key", "node"))


@query("network_components", f"WITH RECURSIVE {NET}, r(node, c) AS (SELECT node, node FROM deg UNION SELECT s.neighbour, r.c FROM r JOIN sym s ON s.node = r.node WHERE r.c < s.neighbour) SELECT node, min(c) AS component FROM r GROUP BY node")
def _(spark, d):
    return components.connected_components(_net(spark, d))


@query("largest_component", f"""WITH RECURSIVE {NET}, r(node, c) AS (SELECT node, node FROM deg UNION SELECT s.neighbour, r.c FROM r JOIN sym s ON s.node = r.node WHERE r.c < s.neighbour),
comp AS (SELECT node, min(c) AS component FROM r GROUP BY node), top AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT src, dst FROM net WHERE src IN (SELECT node FROM comp WHERE component = (SELECT component FROM top))""")
def _(spark, d):
    net = _net(spark, d)
    comp = cut(components.connected_components(net))
    top = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return network.induced(net, comp.join(F.broadcast(top), "component").select("node"))


@query("bfs_distances", f"WITH RECURSIVE {NET}, b(source, node, dist) AS (SELECT node, node, 0 FROM few UNION SELECT b.source, s.neighbour, b.dist + 1 FROM b JOIN sym s ON s.node = b.node WHERE b.dist < 40 AND NOT EXISTS (SELECT 1 FROM recurring.b k WHERE k.source = b.source AND k.node = s.neighbour)) SELECT source, node, min(dist)::INT AS distance FROM b GROUP BY source, node")
def _(spark, d):
    return paths.distances(_net(spark, d), _few(spark, d))


@query("set_distance")
def _(spark, d):
    net = _net(spark, d)
    return rounded(paths.set_distance(net, _few(spark, d), _economy(spark, d).withColumnRenamed("key", "node")), "mean_min_distance", "mean_distance")


@query("shortest_paths")
def _(spark, d):
    return paths.shortest_paths(_net(spark, d), _few(spark, d)).select("source", "node", F.array_join("path", ",").alias("path"))


@query("path_edges")
def _(spark, d):
    return paths.path_edges(paths.shortest_paths(_net(spark, d), _few(spark, d)))


TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM net x JOIN net y ON x.dst = y.src JOIN net z ON z.src = x.src AND z.dst = y.dst)"


@query("triangles", f"WITH {NET}, {TRI} SELECT a, b, c FROM tri")
def _(spark, d):
    return network.triangles(_net(spark, d))


@query("clustering_coefficient", f"""WITH {NET}, {TRI}, t AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) x GROUP BY node)
SELECT node, degree, round(CASE WHEN degree = 1 THEN 1.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END, 8)::DOUBLE AS cliqueness FROM deg LEFT JOIN t USING (node)""")
def _(spark, d):
    return rounded(network.clustering_coefficient(_net(spark, d)), "cliqueness")


@query("shared_neighbour_distance", f"""WITH {NET}, sh AS (SELECT n.src, n.dst, count(*) AS k FROM net n JOIN sym a ON a.node = n.src JOIN sym b ON b.node = n.dst AND a.neighbour = b.neighbour GROUP BY n.src, n.dst)
SELECT n.src, n.dst, round(1.0 - (coalesce(k, 0) + 1)::DOUBLE / least(x.degree, y.degree), 8)::DOUBLE AS distance FROM net n JOIN deg x ON x.node = n.src JOIN deg y ON y.node = n.dst LEFT JOIN sh USING (src, dst)""")
def _(spark, d):
    return rounded(network.shared_neighbour_distance(_net(spark, d)), "distance")


MOD = """c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part), e AS (SELECT a.cluster AS cs, b.cluster AS cd FROM net JOIN c a ON a.node = src JOIN c b ON b.node = dst),
ends AS (SELECT cs AS cluster, cs = cd AS inner_ FROM e UNION ALL SELECT cd, cs = cd FROM e),
per AS (SELECT cluster, count(*) AS degree_sum, (count(*) FILTER (inner_) / 2)::BIGINT AS inside FROM ends GROUP BY cluster), sz AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster), m AS (SELECT count(*) AS m FROM net)"""


@query("modularity_by_brand", f"WITH {NET}, {MOD} SELECT cluster, size, coalesce(inside, 0) AS inside, coalesce(degree_sum, 0) AS degree_sum, round(coalesce(inside, 0) / m - pow(coalesce(degree_sum, 0) / (2.0 * m), 2), 8)::DOUBLE AS modularity FROM sz LEFT JOIN per USING (cluster), m")
def _(spark, d):
    return rounded(network.modularity(_net(spark, d), _brands(spark, d)), "modularity")


@query("conductance_by_brand", f"WITH {NET}, {MOD} SELECT cluster, (degree_sum - 2 * inside)::BIGINT AS boundary, degree_sum AS volume, round((degree_sum - 2 * inside)::DOUBLE / least(degree_sum, 2 * m - degree_sum), 8)::DOUBLE AS conductance FROM per, m")
def _(spark, d):
    return rounded(network.conductance(_net(spark, d), _brands(spark, d)).where("volume > 0"), "conductance")


@query("betweenness")
def _(spark, d):
    net = _net(spark, d)
    return rounded(motifs.betweenness(net, network.vertices(net)), "betweenness", digits=6)


@query("edge_betweenness")
def _(spark, d):
    net = _net(spark, d)
    return rounded(motifs.edge_betweenness(net, network.vertices(net)), "betweenness", digits=6)


@query("maximal_cliques")
def _(spark, d):
    return motifs.maximal_cliques(_net(spark, d)).select(F.array_join("members", ",").alias("members"), "size")


@query("spectral_split")
def _(spark, d):
    return modularity.spectral_split(_net(spark, d)).select("node", "side")


@query("spectral_clusters")
def _(spark, d):
    return modularity.spectral_clusters(_net(spark, d))


@query("tuned_split")
def _(spark, d):
    """Brands split by a hash of the part, then tuned."""
    side = F.when(F.substring(F.md5(F.col("node").cast("string")), 1, 1) < "8", 1).otherwise(-1)
    return modularity.tuned_split(_net(spark, d), _brands(spark, d).withColumn("side", side))


@query("module_discovery")
def _(spark, d):
    """Modules among economy parts, against those of a hundred random sets of parts."""
    found = modularity.module_discovery(_net(spark, d), _economy(spark, d).withColumnRenamed("key", "node"))
    return rounded(found, "modularity", "p_value", "fdr")


@query("grown_components")
def _(spark, d):
    return rounded(motifs.grow_components(_net(spark, d), _centred_scores(spark, d), _few(spark, d)), "score")


@query("connecting_network")
def _(spark, d):
    return motifs.connect(_net(spark, d), _few(spark, d))


ARCS = "arcs AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) + 1 AS dst FROM lineitem WHERE l_linenumber = 7 AND l_quantity = 50 AND l_returnflag <> 'N')"


@query("simple_cycles", f"WITH RECURSIVE {ARCS}, w(cycle, last, done) AS (SELECT [src], src, false FROM (SELECT src FROM arcs UNION SELECT dst FROM arcs) x UNION ALL SELECT CASE WHEN dst = cycle[1] THEN cycle ELSE list_append(cycle, dst) END, dst, dst = cycle[1] FROM w JOIN arcs ON src = last WHERE NOT done AND (dst = cycle[1] OR (dst > cycle[1] AND NOT list_contains(cycle, dst)))) SELECT array_to_string(cycle, ',') AS cycle, len(cycle)::INT AS length FROM w WHERE done")
def _(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 7 and l_quantity = 50 and l_returnflag <> 'N'")
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    arcs = li.crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.pmod("l_partkey", F.col("n")) + 1).alias("dst")).distinct()
    return motifs.simple_cycles(arcs).select(F.array_join("cycle", ",").alias("cycle"), "length")


# ---------------------------------------------------------------- sets and tables


@query("inverted_sets", f"WITH {ANN} SELECT term, count(*) AS n_keys, string_agg(key::VARCHAR, ',' ORDER BY key) AS keys FROM ann GROUP BY term")
def _(spark, d):
    return _annotation(spark, d).groupBy("term").agg(F.array_sort(F.collect_set("key")).alias("keys")).select("term", F.size("keys").cast("long").alias("n_keys"), F.array_join("keys", ",").alias("keys"))


@query("set_algebra", f"""WITH {ANN}, s AS (SELECT term, list(key) AS keys FROM ann GROUP BY term)
SELECT a.term AS a, b.term AS b, len(list_intersect(a.keys, b.keys))::INT AS shared, round(len(list_intersect(a.keys, b.keys))::DOUBLE / len(list_distinct(list_concat(a.keys, b.keys))), 8) AS jaccard,
round(len(list_intersect(a.keys, b.keys))::DOUBLE / least(len(a.keys), len(b.keys)), 8) AS overlap FROM s a JOIN s b ON a.term < b.term AND len(list_intersect(a.keys, b.keys)) > 0""")
def _(spark, d):
    a = _annotation(spark, d)
    size = a.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    l, r = a.alias("l"), a.alias("r")
    both = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.term") < F.col("r.term"))).groupBy(F.col("l.term").alias("a"), F.col("r.term").alias("b")).agg(F.count(F.lit(1)).cast("int").alias("shared"))
    both = both.join(size.select(F.col("term").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b")
    return rounded(both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("overlap")), "jaccard", "overlap")


@query("set_measures", f"""WITH {ANN}, s AS (SELECT term, list(key) AS keys FROM ann GROUP BY term), p AS (SELECT a.key, a.term AS a, b.term AS b FROM ann a JOIN ann b ON a.key = b.key AND a.term < b.term)
SELECT a, b, round(len(list_intersect(x.keys, y.keys))::DOUBLE / len(list_distinct(list_concat(x.keys, y.keys))), 8) AS jaccard, round(len(list_intersect(x.keys, y.keys))::DOUBLE / least(len(x.keys), len(y.keys)), 8) AS overlap
FROM (SELECT DISTINCT a, b FROM p) JOIN s x ON x.term = a JOIN s y ON y.term = b""")
def _(spark, d):
    """Jaccard and overlap of the part sets of all suppliers that share a part."""
    a = _annotation(spark, d)
    sets = cut(a.groupBy("term").agg(F.collect_set("key").alias("keys")))
    pairs = network.co_occurrence(a, "key", "term")
    both = pairs.join(sets.select(F.col("term").alias("src"), F.col("keys").alias("x")), "src").join(sets.select(F.col("term").alias("dst"), F.col("keys").alias("y")), "dst")
    return rounded(both.select(F.col("src").alias("a"), F.col("dst").alias("b"), st.jaccard("x", "y").alias("jaccard"), st.overlap("x", "y").alias("overlap")), "jaccard", "overlap")


@query("last_wins_map", "SELECT l_partkey AS key, max_by(l_suppkey, (l_orderkey, l_linenumber)) AS value FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.max_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).alias("value"))


@query("term_usage", "SELECT p_type AS term, count(*) AS n FROM part GROUP BY p_type")
def _(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("contingency_pivot", "SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_type = 'STANDARD') AS standard, count(*) FILTER (p_type = 'PROMO') AS promo FROM part GROUP BY p_brand")
def _(spark, d):
    wide = table(spark, d, "part").groupBy("p_brand").pivot("p_type", ["ECONOMY", "STANDARD", "PROMO"]).count().na.fill(0)
    return wide.select("p_brand", F.col("ECONOMY").alias("economy"), F.col("STANDARD").alias("standard"), F.col("PROMO").alias("promo"))


@query("cluster_sizes", "SELECT p_brand AS cluster, count(*) AS size, (row_number() OVER (ORDER BY count(*) DESC, p_brand))::INT AS rank FROM part GROUP BY p_brand")
def _(spark, d):
    sizes = _brands(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")))


@query("cluster_edges", f"WITH {NET}, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part), n AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster), e AS (SELECT a.cluster, count(*) AS k FROM net JOIN c a ON a.node = src JOIN c b ON b.node = dst AND a.cluster = b.cluster GROUP BY a.cluster) SELECT cluster, size, coalesce(k, 0) AS edges, round(coalesce(k, 0)::DOUBLE / size, 8) AS edges_per_node FROM n LEFT JOIN e USING (cluster)")
def _(spark, d):
    inner = network.within_clusters(_net(spark, d), _brands(spark, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"))
    sizes = _brands(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    out = sizes.join(inner, "cluster", "left").na.fill(0, ["edges"])
    return rounded(out.select("cluster", "size", "edges", (F.col("edges") / F.col("size")).alias("edges_per_node")), "edges_per_node")


@query("left_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F') o ON l_orderkey = o_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")


@query("three_way_join", "SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' GROUP BY r_name, n_name")
def _(spark, d):
    n = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


# ---------------------------------------------------------------- enrichment and statistics

TERMS = """n AS (SELECT count(DISTINCT key) AS total FROM ann), size AS (SELECT term, count(*) AS n FROM ann GROUP BY term), q AS (SELECT p_partkey AS key FROM part WHERE p_type = 'ECONOMY'),
t AS (SELECT count(*) AS touched FROM q WHERE key IN (SELECT key FROM ann)), h AS (SELECT term, count(*) AS hits FROM ann JOIN q USING (key) GROUP BY term),
e AS (SELECT term, hits, touched, size.n, size.n / total AS ratio FROM h JOIN size USING (term), n, t),
p AS (SELECT *, CASE WHEN ratio >= 1 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(hits, touched + 1), lambda i: exp(lgamma(touched + 1) - lgamma(i + 1) - lgamma(touched - i + 1) + i * ln(ratio) + (touched - i) * ln(1 - ratio))))) END AS p_value FROM e)"""


@query("term_sizes", f"WITH {ANN}, n AS (SELECT count(DISTINCT key) AS total FROM ann) SELECT term, count(*) AS n, round(count(*)::DOUBLE / total, 8) AS ratio FROM ann, n GROUP BY term, total")
def _(spark, d):
    return rounded(enrichment.term_sizes(_annotation(spark, d)), "ratio")


@query("enrich_parts_by_supplier", f"WITH {ANN}, {TERMS}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, term) AS rk, count(*) OVER () AS k FROM p) SELECT term, hits, touched, n, round(ratio, 8) AS ratio, round(p_value, 8) AS p_value, round(min(p_value * k / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 8) AS fdr FROM r")
def _(spark, d):
    e = enrichment.enrich(_economy(spark, d), _annotation(spark, d))
    return rounded(e.select("term", "hits", "touched", "n", "ratio", "p_value", "fdr"), "ratio", "p_value", "fdr")


@query("enrichment_reference_fdr", f"WITH {ANN}, {TERMS}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, term) AS rk, count(*) OVER () AS k FROM p) SELECT term, round(p_value, 8) AS p_value, round(min(p_value * (k // rk)) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 8) AS fdr FROM r")
def _(spark, d):
    e = enrichment.enrich(_economy(spark, d), _annotation(spark, d), mode="reference")
    return rounded(e.select("term", "p_value", "fdr"), "p_value", "fdr")


@query("enrichment_permutations")
def _(spark, d):
    background = network.vertices(_net(spark, d)).withColumnRenamed("node", "key")
    return rounded(enrichment.permutation_fdr(_economy(spark, d), _annotation(spark, d), background, 20), "p_value", "fdr")


HYP = "least(1.0, list_sum(list_transform(range(hits, least(in_term, size) + 1), lambda i: exp({} + {} - {}))))"


@query("cluster_terms", f"""WITH {ANN}, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part WHERE p_partkey IN (SELECT key FROM ann)), tot AS (SELECT count(*) AS total FROM c), sz AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster),
m AS (SELECT term, count(*) AS in_term FROM ann WHERE key IN (SELECT node FROM c) GROUP BY term), b AS (SELECT cluster, term, count(*) AS hits FROM c JOIN ann ON node = key GROUP BY cluster, term),
x AS (SELECT cluster, term, size, in_term, hits, {HYP.format(_lchoose("in_term", "i"), _lchoose("(total - in_term)", "(size - i)"), _lchoose("total", "size"))} AS p_value FROM b JOIN sz USING (cluster) JOIN m USING (term), tot WHERE size >= 3)
SELECT cluster, term, size, in_term, hits, round(p_value, 8) AS p_value FROM x WHERE p_value <= 0.05""")
def _(spark, d):
    return rounded(enrichment.cluster_terms(_brands(spark, d), _annotation(spark, d), cut=0.05), "p_value")


TABLES = "t AS (SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY' AND p_size <= 25)::INT AS a, count(*) FILTER (p_type = 'ECONOMY' AND p_size > 25)::INT AS b, count(*) FILTER (p_type <> 'ECONOMY' AND p_size <= 25)::INT AS c, count(*) FILTER (p_type <> 'ECONOMY' AND p_size > 25)::INT AS d FROM part GROUP BY p_brand)"
POINT = "exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma({0} + 1) - lgamma(a + b - {0} + 1) - lgamma(a + c - {0} + 1) - lgamma(d - a + {0} + 1))"


@query("fisher_tables", f"""WITH {TABLES} SELECT p_brand, a, b, c, d, round({POINT.format("a")}, 8) AS point, round(least(1.0, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda i: {POINT.format("i")}))), 8) AS right_tail,
round(least(1.0, list_sum(list_transform(range(greatest(0, a - d), a + 1), lambda i: {POINT.format("i")}))), 8) AS left_tail,
round(least(1.0, list_sum(list_filter(list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda i: {POINT.format("i")}), lambda x: x <= {POINT.format("a")} * (1 + 1e-9)))), 8) AS two_tailed FROM t""")
def _(spark, d):
    eco, small = F.col("p_type") == "ECONOMY", F.col("p_size") <= 25
    n = lambda c, name: F.count(F.when(c, 1)).cast("int").alias(name)
    t = table(spark, d, "part").groupBy("p_brand").agg(n(eco & small, "a"), n(eco & ~small, "b"), n(~eco & small, "c"), n(~eco & ~small, "d"))
    cells = [F.col(x) for x in "abcd"]
    out = t.select("*", sp.fisher_point(*cells).alias("point"), sp.fisher_right(*cells).alias("right_tail"), sp.fisher_left(*cells).alias("left_tail"), sp.fisher_two_tailed(*cells).alias("two_tailed"))
    return rounded(out, "point", "right_tail", "left_tail", "two_tailed")


@query("proportions", "WITH o AS (SELECT count(*) FILTER (p_size <= 25)::DOUBLE AS s2, count(*)::DOUBLE AS n2 FROM part), g AS (SELECT p_brand, count(*) FILTER (p_size <= 25)::DOUBLE AS s1, count(*)::DOUBLE AS n1 FROM part GROUP BY p_brand) SELECT p_brand, round((s1 / n1 - s2 / n2) / sqrt((s1 + s2) / (n1 + n2) * (1 - (s1 + s2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 8) AS z, round((s1 / n1 - s2 / n2) / sqrt(s2 / n2 * (1 - s2 / n2) / n1), 8) AS z_one, round(s1 / n1 / (s2 / n2), 8) AS enrichment, round(pow(greatest(abs(s1 - n1 * s2 / n2) - 0.5, 0), 2) / (n1 * s2 / n2) + pow(greatest(abs(s1 - n1 * s2 / n2) - 0.5, 0), 2) / (n1 * (1 - s2 / n2)), 8) AS chi_square FROM g, o")
def _(spark, d):
    p = table(spark, d, "part")
    count = [F.count(F.when(F.col("p_size") <= 25, 1)).cast("double"), F.count(F.lit(1)).cast("double")]
    g = p.groupBy("p_brand").agg(count[0].alias("s1"), count[1].alias("n1")).crossJoin(F.broadcast(p.agg(count[0].alias("s2"), count[1].alias("n2"))))
    s1, n1, s2, n2 = (F.col(x) for x in ("s1", "n1", "s2", "n2"))
    out = g.select("p_brand", st.two_proportion_z(s1, n1, s2, n2).alias("z"), st.one_proportion_z(s1 / n1, s2 / n2, n1).alias("z_one"), st.enrichment_ratio(s2 / n2, n1, s1).alias("enrichment"), st.proportion_chi_square(s1, n1, s2 / n2).alias("chi_square"))
    return rounded(out, "z", "z_one", "enrichment", "chi_square")


@query("proportion_p_values")
def _(spark, d):
    p = table(spark, d, "part")
    g = p.groupBy("p_brand").agg(F.count(F.when(F.col("p_size") <= 25, 1)).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    out = g.select("p_brand", st.one_proportion_p(F.col("s") / F.col("n"), F.lit(0.5), F.col("n")).alias("p_normal"), st.proportion_test(F.col("s"), F.col("n"), F.lit(0.5)).alias("p_chi_square"))
    return rounded(out, "p_normal", "p_chi_square")


WELCH = "w AS (SELECT event_type, count(value) FILTER (wd) AS n1, count(value) FILTER (NOT wd) AS n2, avg(value) FILTER (wd) AS m1, avg(value) FILTER (NOT wd) AS m2, var_samp(value) FILTER (wd) AS v1, var_samp(value) FILTER (NOT wd) AS v2 FROM (SELECT *, isodow(ts) <= 5 AS wd FROM events) x GROUP BY event_type)"


@query("welch_t", f"WITH {WELCH} SELECT event_type, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM w")
def _(spark, d):
    e = table(spark, d, "events")
    out = st.welch(e, ["event_type"], ~F.dayofweek("ts").isin(1, 7), "value")
    return rounded(rounded(out, "t", digits=6), "df", digits=4).drop("p")


@query("welch_p_values")
def _(spark, d):
    return rounded(st.welch(table(spark, d, "events"), ["event_type"], ~F.dayofweek("ts").isin(1, 7), "value"), "p").select("event_type", "p")


@query("combined_p_values", f"WITH {ANN}, {TERMS}, g AS (SELECT (term % 5)::INT AS family, count(*) AS k, -2 * sum(ln(p_value)) AS s FROM p GROUP BY term % 5) SELECT family, k, round(s, 6) AS statistic, round(exp(-s / 2) * list_sum(list_transform(range(0, k), lambda i: exp(i * ln(s / 2) - lgamma(i + 1)))), 8) AS combined FROM g")
def _(spark, d):
    e = enrichment.enrich(_economy(spark, d), _annotation(spark, d)).withColumn("family", (F.col("term") % 5).cast("int"))
    return rounded(rounded(st.combine_p_values(e, "family", "p_value"), "statistic", digits=6), "combined")


@query("dependent_p_values")
def _(spark, d):
    days = _days(spark, d).select(F.col("feature").alias("series"), "sample", "value")
    p = st.welch(table(spark, d, "events"), ["event_type"], ~F.dayofweek("ts").isin(1, 7), "value").select(F.col("event_type").alias("series"), "p")
    return rounded(st.dependent_p_values(days, p), "statistic", "df", "scale", "combined", digits=6)


@query("empirical_fdr", "WITH real AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), rnd AS (SELECT s_acctbal AS v FROM supplier), n AS (SELECT (SELECT count(*) FROM real) AS na, (SELECT count(*) FROM rnd) AS nb) SELECT id, v, round(least(1.0, ((SELECT count(*) FROM rnd WHERE rnd.v >= real.v)::DOUBLE / nb) / ((SELECT count(*) FROM real r2 WHERE r2.v >= real.v)::DOUBLE / na)), 8) AS fdr FROM real, n")
def _(spark, d):
    real = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return rounded(st.empirical_fdr(real, table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), "v").select("id", "v", "fdr"), "fdr")


@query("vector_distances", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: pow(a.e[i] - b.e[i], 2)))), 8) AS euclidean, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 8) AS dot, len(list_filter(range(1, len(a.e) + 1), lambda i: (a.e[i] > 0) <> (b.e[i] > 0)))::DOUBLE AS hamming FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("e").alias("x")).join(v.select(F.col("vec_id").alias("b"), F.col("e").alias("y")), "b")
    sign = lambda c: F.transform(c, lambda x: x > 0)
    return rounded(pairs.select("a", "b", st.euclidean(F.col("x"), F.col("y")).alias("euclidean"), st.dot(F.col("x"), F.col("y")).alias("dot"), st.hamming(sign("x"), sign("y")).alias("hamming")), "euclidean", "dot")


# ---------------------------------------------------------------- matrices


@query("expr_log", f"WITH {MAT} SELECT feature, sample, round(CASE WHEN value > 0 THEN ln(value) END, 8) AS value FROM mat")
def _(spark, d):
    return rounded(expression.log_transform(_matrix(spark, d)), "value")


@query("expr_zscore_sample", f"WITH {MAT}, s AS (SELECT sample, avg(value) AS m, stddev_samp(value) AS s FROM mat GROUP BY sample) SELECT feature, sample, round((value - m) / s, 8) AS value FROM mat JOIN s USING (sample)")
def _(spark, d):
    return rounded(expression.z_score_by_sample(_matrix(spark, d)), "value")


@query("expr_zscore_global", f"WITH {MAT}, s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM mat) SELECT feature, sample, round((value - m) / s, 8) AS value FROM mat, s")
def _(spark, d):
    return rounded(expression.z_score(_matrix(spark, d)), "value")


@query("expr_rank", f"WITH {MAT} SELECT feature, sample, round(rank() OVER (PARTITION BY sample ORDER BY value DESC)::DOUBLE / count(value) OVER (PARTITION BY sample), 8) AS value FROM mat WHERE value IS NOT NULL")
def _(spark, d):
    return rounded(expression.rank_by_sample(_matrix(spark, d)), "value")


@query("expr_centre", f"WITH {MAT}, c AS (SELECT feature, median(value) AS c FROM mat GROUP BY feature) SELECT feature, sample, round(value - c, 8) AS value FROM mat JOIN c USING (feature)")
def _(spark, d):
    return rounded(expression.centre_by_feature(_matrix(spark, d)), "value")


@query("expr_wide", f"WITH {DAYS} SELECT sample, round(max(value) FILTER (feature = 'click'), 8) AS click, round(max(value) FILTER (feature = 'view'), 8) AS view FROM days GROUP BY sample")
def _(spark, d):
    flipped = _days(spark, d).select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")
    return rounded(expression.to_wide(flipped, ["click", "view"]).withColumnRenamed("feature", "sample"), "click", "view")


@query("expr_edge_correlation", f"WITH {NET}, m AS (SELECT l_partkey AS feature, strftime(l_shipdate, '%Y-%m') AS sample, avg(l_quantity) AS value FROM lineitem GROUP BY ALL) SELECT src, dst, count(*) AS n, round(CASE WHEN var_pop(a.value) = 0 OR var_pop(b.value) = 0 THEN 1.0 ELSE corr(a.value, b.value) END, 6) AS correlation FROM net JOIN m a ON a.feature = src JOIN m b ON b.feature = dst AND a.sample = b.sample GROUP BY src, dst")
def _(spark, d):
    return rounded(expression.edge_correlation(_monthly(spark, d), _net(spark, d)), "correlation", digits=6)


@query("expr_spearman", "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY event_type")
def _(spark, d):
    return rounded(expression.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id"), "spearman", digits=6)


@query("expr_set_average", f"WITH {MAT} SELECT (feature % 10)::BIGINT AS \"set\", sample, round(avg(value), 8) AS value FROM mat GROUP BY ALL")
def _(spark, d):
    m = _matrix(spark, d)
    return rounded(expression.average_over(m, m.select("feature", F.pmod("feature", F.lit(10)).alias("set")).distinct()), "value")


BINS = f"""{DAYS}, g AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n, floor(ln(count(value)) / ln(2))::INT + 1 AS bins FROM days GROUP BY feature),
b AS (SELECT feature, sample, least(greatest(floor((value - m + 2 * s) / (4 * s / bins)), 0), bins - 1)::INT AS bin FROM days JOIN g USING (feature))"""


@query("discretised", f"WITH {BINS} SELECT feature, sample, bin FROM b")
def _(spark, d):
    return expression.discretise(_days(spark, d)).select("feature", "sample", "bin")


@query("mutual_information", f"WITH {BINS}, c AS (SELECT feature, bin, isodow(sample::DATE) <= 5 AS type, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, type) AS nt FROM c) SELECT feature, round(sum(n / t * ln(n * t / (nb * nt))), 8)::DOUBLE AS score FROM w GROUP BY feature")
def _(spark, d):
    days = _days(spark, d)
    types = days.select("sample").distinct().withColumn("type", ~F.dayofweek(F.to_date("sample")).isin(1, 7))
    return rounded(expression.mutual_information(days, types), "score")


# ---------------------------------------------------------------- mutations


@query("maf_counts", "SELECT l_suppkey AS sample, count(*) AS mutations FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return mutation.counts_by_sample(_maf(spark, d))


@query("maf_genes_by_sample", "SELECT l_suppkey AS sample, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS genes FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber <= 4 GROUP BY l_suppkey")
def _(spark, d):
    lengths = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.lit(4).alias("length"))
    genes = mutation.genes_by_sample(_maf(spark, d), ["A", "R"], lengths)
    return genes.select("sample", F.array_join(F.array_sort(F.transform("genes", lambda g: g.cast("string"))), ",").alias("genes"))


@query("maf_max_score", "WITH g AS (SELECT max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag <> 'R') SELECT l_suppkey AS sample, l_partkey AS gene, max(CASE WHEN l_returnflag = 'R' THEN top ELSE l_extendedprice END) AS score FROM lineitem, g GROUP BY ALL")
def _(spark, d):
    return mutation.score_by_sample_gene(_maf(spark, d), ["R"])


@query("maf_gene_score", "SELECT l_partkey AS gene, max(l_extendedprice) AS score FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 1) GROUP BY l_partkey")
def _(spark, d):
    out = table(spark, d, "supplier").where("s_nationkey = 1").select(F.col("s_suppkey").alias("sample"))
    return mutation.score_by_gene(_maf(spark, d), out)


@query("maf_site_frequency", "SELECT l_partkey AS gene, l_linenumber AS position, count(*) AS n FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL")
def _(spark, d):
    return mutation.site_frequency(_maf(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.lit(5).alias("length")))


@query("maf_site_vector", "WITH s AS (SELECT l_partkey AS gene, list_transform(range(1, 6), lambda i: len(list_filter(list(l_linenumber), lambda x: x = i))) AS v FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_partkey) SELECT gene, array_to_string(v, ',') AS counts FROM s")
def _(spark, d):
    lengths = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.lit(5).alias("length"))
    v = mutation.site_vector(mutation.site_frequency(_maf(spark, d), lengths), lengths)
    return v.select("gene", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


@query("maf_annotated", "WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus THEN NULL ELSE 'hg19,' || (l_suppkey % 23)::VARCHAR || ',' || l_partkey::VARCHAR || ',' || l_returnflag || ',' || l_linestatus END AS key FROM lineitem), s AS (SELECT 'hg19,' || (l_suppkey % 23)::VARCHAR || ',' || l_partkey::VARCHAR || ',R,F' AS key, max(l_extendedprice) AS fi_score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey, l_linenumber, key, fi_score FROM m LEFT JOIN s USING (key)")
def _(spark, d):
    li = table(spark, d, "lineitem")
    chromosome = F.pmod("l_suppkey", F.lit(23)).cast("string")
    maf = li.select("l_orderkey", "l_linenumber", chromosome.alias("chromosome"), F.col("l_partkey").alias("start"), F.col("l_returnflag").alias("ref"), F.col("l_returnflag").alias("allele1"), F.col("l_linestatus").alias("allele2"))
    scores = li.where("l_returnflag = 'R'").groupBy(F.concat_ws(",", F.lit("hg19"), chromosome, F.col("l_partkey").cast("string"), F.lit("R"), F.lit("F")).alias("key")).agg(F.max("l_extendedprice").alias("score"))
    return mutation.annotate_scores(maf, scores).select("l_orderkey", "l_linenumber", "key", "fi_score")


# ---------------------------------------------------------------- text, hierarchy, randomness, diffusion

TOKENS = "tok AS (SELECT doc_id AS doc, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents) x WHERE term <> '' GROUP BY ALL)"


@query("tfidf_documents", f"WITH {TOKENS}, a AS (SELECT doc, sum(n) AS total FROM tok GROUP BY doc), b AS (SELECT term, count(DISTINCT doc) AS df FROM tok GROUP BY term), c AS (SELECT count(DISTINCT doc) AS docs FROM tok) SELECT doc, term, round(n / total * log10(docs / df), 8)::DOUBLE AS weight FROM tok JOIN a USING (doc) JOIN b USING (term), c")
def _(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").repartition("doc")  # texts are fewer and smaller than their words' rows
    words = texts.select("doc", F.explode(F.split(F.lower("text"), " ")).alias("term")).where("term <> ''")
    return rounded(clustering.tf_idf(words.select("doc", "term", F.lit(1).cast("long").alias("n"))), "weight")


ONTO = "onto AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def _hierarchy(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return n.union(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))


@query("ontology_descendants", f"WITH RECURSIVE {ONTO}, t(root, term, depth) AS (SELECT DISTINCT parent, parent, 0 FROM onto UNION SELECT t.root, child, depth + 1 FROM t JOIN onto ON parent = term) SELECT root, term, min(depth)::INT AS depth FROM t WHERE depth > 0 GROUP BY root, term")
def _(spark, d):
    h = _hierarchy(spark, d)
    return ontology.descendants(h, h.select(F.col("parent").alias("root")).distinct())


@query("ontology_keys", f"WITH RECURSIVE {ONTO}, t(root, term) AS (SELECT DISTINCT parent, parent FROM onto WHERE parent LIKE 'r%' UNION SELECT t.root, child FROM t JOIN onto ON parent = term) SELECT root, count(DISTINCT o_orderkey) AS orders FROM t JOIN orders ON term = 'c' || o_custkey GROUP BY root")
def _(spark, d):
    h = _hierarchy(spark, d)
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("c"), "o_custkey").alias("term"))
    return ontology.keys_under(keys, h, h.where("parent like 'r%'").select(F.col("parent").alias("root")).distinct()).groupBy("root").agg(F.count(F.lit(1)).alias("orders"))


@query("random_sample", "SELECT (perm)::INT AS perm, p_partkey AS key FROM (SELECT perm, p_partkey, row_number() OVER (PARTITION BY perm ORDER BY md5('s:' || perm || ':' || p_partkey), p_partkey) AS r FROM part, range(0, 5) t(perm)) x WHERE r <= 50")
def _(spark, d):
    return enrichment.sample_by_hash(table(spark, d, "part").select("p_partkey"), "p_partkey", 50, 5)


@query("permuted_scores", "WITH m AS (SELECT p_partkey AS node, p_retailprice AS score FROM part), a AS (SELECT perm, node, row_number() OVER (PARTITION BY perm ORDER BY md5('hn:' || perm || ':' || node), node) AS r FROM m, range(0, 3) t(perm)), b AS (SELECT perm, score, row_number() OVER (PARTITION BY perm ORDER BY md5('hs:' || perm || ':' || node), node) AS r FROM m, range(0, 3) t(perm)) SELECT a.perm::INT AS perm, node, score FROM a JOIN b ON a.perm = b.perm AND a.r = b.r")
def _(spark, d):
    return diffusion.permuted_scores(table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score")), 3)


@query("configuration_model", f"WITH {NET}, s AS (SELECT src AS node, 0 AS side, src || '-' || dst AS edge FROM net UNION ALL SELECT dst, 1, src || '-' || dst FROM net), r AS (SELECT node, (row_number() OVER (ORDER BY md5('c:' || edge || ':' || side), side, node, edge) - 1) // 2 AS pair FROM s) SELECT DISTINCT src, dst FROM (SELECT min(node) AS src, max(node) AS dst, count(*) AS n FROM r GROUP BY pair) x WHERE n = 2 AND src <> dst")
def _(spark, d):
    return random_nets.configuration_model(_net(spark, d))


@query("random_pairs")
def _(spark, d):
    net = _net(spark, d)
    return random_nets.random_pairs(network.vertices(net), 1000, net)


@query("random_graph")
def _(spark, d):
    net = cut(_net(spark, d))
    return random_nets.random_graph(network.vertices(net), net.count())


@query("random_keep_degrees")
def _(spark, d):
    return random_nets.keep_degrees(_net(spark, d))


@query("switched_network")
def _(spark, d):
    return random_nets.switch_edges(_net(spark, d))


@query("approximate_pagerank")
def _(spark, d):
    return rounded(diffusion.approximate_pagerank(_net(spark, d), _few(spark, d), 0.15, 1e-3), "p", "residue")


@query("sweep_cut")
def _(spark, d):
    net = _net(spark, d)
    return rounded(diffusion.sweep(net, diffusion.approximate_pagerank(net, _few(spark, d), 0.15, 1e-3)), "conductance")


@query("nibble_clusters")
def _(spark, d):
    return diffusion.nibble(_net(spark, d), _few(spark, d, 3), 0.9, 4)


def _hot(spark, d):
    net = _net(spark, d)
    kernel = settled(diffusion.heat_kernel(net, network.vertices(net), 0.3, error=1e-3))
    return net, kernel, _scores(spark, d)


@query("hot_modules")
def _(spark, d):
    net, kernel, scores = _hot(spark, d)
    return diffusion.hot_modules(diffusion.hot_edges(kernel, net, scores), 0.05)


@query("hot_module_significance")
def _(spark, d):
    """A thousand permutations, as many as the replaced library takes."""
    net, kernel, scores = _hot(spark, d)
    return rounded(diffusion.module_significance(kernel, net, scores, 0.05, 1000), "p_value", "fdr")


# ---------------------------------------------------------------- clustering


def _brand_pairs(spark, d) -> DataFrame:
    p = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("x"), F.avg("p_size").alias("y"))
    l, r = p.alias("l"), p.alias("r")
    return l.join(r, F.col("l.p_brand") < F.col("r.p_brand")).select(F.col("l.p_brand").alias("src"), F.col("r.p_brand").alias("dst"), F.sqrt(F.pow(F.col("l.x") - F.col("r.x"), 2) + F.pow(F.col("l.y") - F.col("r.y"), 2)).alias("distance"))


@query("spanning_forest")
def _(spark, d):
    net = _net(spark, d)
    return rounded(clustering.spanning_forest(network.shared_neighbour_distance(net)), "distance")


@query("hierarchical_merges")
def _(spark, d):
    return rounded(clustering.agglomerate(_brand_pairs(spark, d)), "distance", digits=6).drop("round")


@query("tree_cut", "WITH RECURSIVE p AS (SELECT p_brand, avg(p_retailprice) AS x, avg(p_size) AS y FROM part GROUP BY p_brand), e AS (SELECT l.p_brand AS src, r.p_brand AS dst FROM p l JOIN p r ON l.p_brand <> r.p_brand WHERE sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) <= 3), t(node, c) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, c FROM t JOIN e ON e.src = t.node) SELECT node, min(c) AS cluster FROM t GROUP BY node")
def _(spark, d):
    merges = clustering.spanning_forest(_brand_pairs(spark, d)).select(F.col("src").alias("left"), F.col("dst").alias("right"), "distance")
    return clustering.cut_tree(merges, 3.0)


@query("self_organising_map")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clustering.SelfOrganisingMap(side=8, steps=5, width=3).fit(v).assign(v)


@query("brand_tour")
def _(spark, d):
    return rounded(motifs.shortest_tour(_brand_pairs(spark, d), islands=8), "length", digits=6)


from lattica import file_queries, report_queries, structure_queries, value_queries  # noqa: E402, F401  they register their queries here
