"""Queries of the report operators, kernels and searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import diffusion, motifs, network, paths, random_nets, reports
from lattica.queries import ANN, MOD, NET, TERMS, _annotation, _brands, _centred_scores, _economy, _few, _net, query, rounded
from lattica.session import cut, shared_path, table

CT = """cc AS (SELECT p_brand AS cluster, p_partkey AS node FROM part), topics AS (SELECT p_brand AS cluster, p_type AS term, count(*) / 1000.0 AS p_value FROM part GROUP BY ALL)"""


def _topics(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_type").alias("term")).agg((F.count(F.lit(1)) / 1000.0).alias("p_value"))


@query("cluster_report", f"WITH {CT}, r AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY p_value, term) AS k FROM topics) SELECT cc.cluster, count(DISTINCT node) AS members, max(t1.term) AS topic1, max(t2.term) AS topic2, max(t3.term) AS topic3 FROM cc LEFT JOIN r t1 ON t1.cluster = cc.cluster AND t1.k = 1 LEFT JOIN r t2 ON t2.cluster = cc.cluster AND t2.k = 2 LEFT JOIN r t3 ON t3.cluster = cc.cluster AND t3.k = 3 GROUP BY cc.cluster")
def _(spark, d):
    return reports.cluster_report(_brands(spark, d), _topics(spark, d))


@query("cluster_best_topic", f"WITH {NET}, {MOD}, {CT.replace('cc AS', 'c2 AS')}, b AS (SELECT cluster, arg_min(term, (p_value, term)) AS term FROM topics GROUP BY cluster) SELECT sz.cluster, size AS members, round(coalesce(inside, 0)::DOUBLE / size, 8) AS cliqueness, term FROM sz LEFT JOIN per USING (cluster) LEFT JOIN b USING (cluster)")
def _(spark, d):
    inner = network.modularity(_net(spark, d), _brands(spark, d)).select("cluster", (F.col("inside") / F.col("size")).alias("cliqueness"))
    return rounded(reports.best_topic(_brands(spark, d), inner, _topics(spark, d)), "cliqueness")


@query("cluster_labels", f"WITH {NET}, c AS (SELECT p_partkey AS node, p_brand AS cluster, degree AS value FROM part JOIN deg ON node = p_partkey), t AS (SELECT cluster, max(value) AS value FROM c GROUP BY cluster) SELECT cluster, value, string_agg(node::VARCHAR, ',' ORDER BY node) AS label FROM c JOIN t USING (cluster, value) GROUP BY ALL")
def _(spark, d):
    return reports.labelled_clusters(_brands(spark, d), network.degrees(_net(spark, d)).withColumnRenamed("degree", "value"))


@query("significant_cluster_topics", f"""WITH {ANN}, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part WHERE p_partkey IN (SELECT key FROM ann)), tot AS (SELECT count(*) AS total FROM c),
sz AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster), m AS (SELECT term, count(*) AS in_term FROM ann GROUP BY term), b AS (SELECT cluster, term, count(*) AS hits FROM c JOIN ann ON node = key GROUP BY cluster, term),
x AS (SELECT cluster, term, size, in_term, hits, least(1.0, list_sum(list_transform(range(hits, least(in_term, size) + 1), lambda i: exp(lgamma(in_term + 1) - lgamma(i + 1) - lgamma(in_term - i + 1) + lgamma(total - in_term + 1) - lgamma(size - i + 1) - lgamma(total - in_term - size + i + 1) - lgamma(total + 1) + lgamma(size + 1) + lgamma(total - size + 1))))) AS p_value FROM b JOIN sz USING (cluster) JOIN m USING (term), tot WHERE size >= 9 AND hits >= in_term + size - total)
SELECT cluster, term, size, in_term, hits, round(p_value, 8) AS p_value FROM x WHERE p_value < 0.1 AND hits > 0.01 * size""")
def _(spark, d):
    return rounded(reports.significant_topics(_brands(spark, d), _annotation(spark, d), p=0.1, share=0.01), "p_value")


@query("enrich_by_type", f"WITH ann AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS term FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'A'), {TERMS} SELECT term, hits, touched, n, round(p_value, 8) AS p_value FROM p")
def _(spark, d):
    kinds = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("term"), F.col("l_returnflag").alias("type")).distinct()
    return rounded(reports.enrich_by_type(_economy(spark, d), kinds, "A").select("term", "hits", "touched", "n", "p_value"), "p_value")


@query("path_enrichment", "SELECT n_nationkey, round(list_sum(list_transform(range(n_regionkey, n_nationkey % 7 + 6), lambda i: exp(lgamma(n_nationkey % 7 + 6) - lgamma(i + 1) - lgamma(n_nationkey % 7 + 6 - i) + i * ln(0.3) + (n_nationkey % 7 + 5 - i) * ln(0.7)))), 8) AS p FROM nation WHERE n_regionkey > 0")
def _(spark, d):
    n = table(spark, d, "nation").where("n_regionkey > 0")
    return rounded(n.select("n_nationkey", reports.path_p_value(F.lit(0.3), (F.col("n_nationkey") % 7 + 5).cast("long"), F.col("n_regionkey").cast("long")).alias("p")), "p")


@query("fdr_texts", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '<1e-03' ELSE printf('%.1e', n_regionkey / 10.0) END AS text FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", reports.fdr_text(F.col("n_regionkey") / 10.0, F.lit(1000), F.lit(25)).alias("text"))


@query("source_letters", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'P' ELSE 'R' END AS letter, p_partkey || chr(9) || p_size AS edge FROM part")
def _(spark, d):
    source = F.when(F.col("p_partkey") % 3 == 0, "KEGG").when(F.col("p_partkey") % 3 == 1, "pantherdb: Panther").otherwise("other")
    name = F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(" : "), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", reports.source_letter(source).alias("letter"), reports.edge_of_name(name).alias("edge"))


@query("adjacent_edges", f"WITH {NET}, o AS (SELECT p_partkey AS item, p_brand AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) SELECT src, dst FROM net JOIN o a ON a.item = src JOIN o b ON b.item = dst WHERE a.g = b.g AND abs(a.i - b.i) <= 3")
def _(spark, d):
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))
    return reports.adjacent(_net(spark, d), reports.positions(lists, "p_brand", "parts"), gap=3)


@query("path_length_groups", f"WITH RECURSIVE {NET}, b(source, node, dist) AS (SELECT node, node, 0 FROM few UNION SELECT b.source, s.neighbour, b.dist + 1 FROM b JOIN sym s ON s.node = b.node WHERE b.dist < 3), m AS (SELECT source, node, min(dist) AS dist FROM b GROUP BY ALL) SELECT p_type AS \"group\", count(*) AS n, round(avg(dist), 8) AS mean_length FROM m JOIN part ON p_partkey = node GROUP BY p_type")
def _(spark, d):
    p = paths.shortest_paths(_net(spark, d), _few(spark, d), 3).join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_type"), "node")
    return rounded(reports.path_lengths(p, "p_type"), "mean_length")


def _edge_topics(spark, d):
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("topic"))
    return _net(spark, d).join(brand, "src").select("src", "dst", "topic")


ONE_STEP = f"WITH {NET}, pe AS (SELECT few.node AS source, neighbour AS node, least(few.node, neighbour) AS src, greatest(few.node, neighbour) AS dst FROM few JOIN sym USING (node))"


@query("path_topics", f"{ONE_STEP} SELECT p_brand AS topic, count(*) AS paths FROM pe JOIN part ON p_partkey = src GROUP BY p_brand")
def _(spark, d):
    e = paths.path_edges(paths.shortest_paths(_net(spark, d), _few(spark, d), 1))
    return reports.topics_on_paths(e, _edge_topics(spark, d))


@query("ranked_paths", f"{ONE_STEP}, r AS (SELECT source, pe.node, 1 AS length, (SELECT count(*) FROM (VALUES (source), (pe.node)) v(x) WHERE x NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')) AS linkers, CASE WHEN src % 2 = 0 THEN 1 ELSE 0 END AS curated, a.degree + b.degree AS degrees FROM pe JOIN deg a ON a.node = source JOIN deg b ON b.node = pe.node) SELECT source, node, length::INT AS length, linkers::BIGINT AS linkers, curated::BIGINT AS curated, degrees::BIGINT AS degrees, row_number() OVER (ORDER BY length, linkers, curated DESC, degrees, source, node) AS place FROM r")
def _(spark, d):
    net = cut(_net(spark, d))
    p = paths.shortest_paths(net, _few(spark, d), 1).where("source <> node")
    return reports.ranked_paths(p, _economy(spark, d).withColumnRenamed("key", "node"), network.degrees(net), net.where("src % 2 = 0"))


@query("partners_within", f"WITH {NET}, e AS (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY') SELECT node, count(*) AS partners FROM sym WHERE neighbour IN (SELECT node FROM e) GROUP BY node")
def _(spark, d):
    return reports.partners_within(_net(spark, d), _economy(spark, d).withColumnRenamed("key", "node"))


RX = "i AS (SELECT DISTINCT l_suppkey AS reaction, l_partkey AS item FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 48), o AS (SELECT DISTINCT l_suppkey AS reaction, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)"


def _reactions(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity >= 48")
    side = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("reaction"), F.col("l_partkey").alias("item")).distinct()
    return side("A"), side("R")


@query("reaction_graph", f"WITH {RX} SELECT DISTINCT o.reaction AS src, i.reaction AS dst FROM o JOIN i USING (item) WHERE item % 5 <> 0")
def _(spark, d):
    takes, gives = _reactions(spark, d)
    return reports.reaction_graph(takes, gives, table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("item")))


@query("open_inputs", f"WITH {RX} SELECT DISTINCT item FROM i WHERE item NOT IN (SELECT item FROM o)")
def _(spark, d):
    return reports.open_inputs(*_reactions(spark, d))


@query("mean_overlap", f"WITH {ANN}, s AS (SELECT term, count(*) AS n FROM ann GROUP BY term), k AS (SELECT a.term AS id, b.term AS other, count(*) AS k FROM ann a JOIN ann b USING (key) GROUP BY ALL), c AS (SELECT term % 7 AS node, count(*) AS c FROM s GROUP BY ALL) SELECT id, node, round(sum(k / least(x.n, y.n)) / any_value(c), 8) AS similarity FROM k JOIN s x ON x.term = id JOIN s y ON y.term = other JOIN c ON node = other % 7 GROUP BY id, node")
def _(spark, d):
    a = _annotation(spark, d)
    nodes = a.select("term").distinct().select((F.col("term") % 7).alias("node"), F.col("term").alias("id"))
    return rounded(reports.mean_overlap(a.select(F.col("term").alias("id"), F.col("key").alias("element")), nodes), "similarity")


@query("mean_distance_within", f"WITH {NET} SELECT sz.cluster AS node, round(coalesce(avg(dst - src), 0), 8)::DOUBLE AS distance FROM (SELECT DISTINCT p_brand AS cluster FROM part) sz LEFT JOIN (SELECT a.p_brand AS cluster, src, dst FROM net JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst AND a.p_brand = b.p_brand) x USING (cluster) GROUP BY sz.cluster")
def _(spark, d):
    pairs = _net(spark, d).withColumn("distance", (F.col("dst") - F.col("src")).cast("double"))
    return rounded(reports.mean_distance_within(pairs, _brands(spark, d).select(F.col("cluster").alias("node"), F.col("node").alias("id"))), "distance")


@query("common_samples", "SELECT c_custkey AS sample, c_acctbal AS value, n.n AS time, n.t AS event FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) n ON o_custkey = c_custkey")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("sample"))
    values = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("value"))
    return reports.common_samples(values, o.agg(F.count(F.lit(1)).alias("time")), o.agg(F.max("o_totalprice").alias("event")))


@query("pagerank_with_priors", "WITH " + NET + ", w0 AS (SELECT node AS seed, node, 1.0::DOUBLE AS rank FROM few), " + ", ".join(f"w{i} AS (SELECT seed, node, sum(rank) AS rank FROM (SELECT seed, neighbour AS node, 0.7 * rank / degree AS rank FROM w{i - 1} JOIN sym USING (node) JOIN deg USING (node) UNION ALL SELECT node, node, 0.3 FROM few) x GROUP BY seed, node)" for i in range(1, 11)) + " SELECT seed, node, round(rank, 8) AS rank FROM w10")
def _(spark, d):
    return rounded(diffusion.pagerank_with_priors(_net(spark, d), _few(spark, d), 0.3, 10), "rank")


SERIES = diffusion.series_terms(0.5, 1e-9)


@query("heat_kernel", "WITH " + NET + ", w0 AS (SELECT node AS source, node, exp(-0.5) AS v FROM few), " + ", ".join(f"w{i} AS (SELECT source, neighbour AS node, sum(v * 0.5 / {i} / degree) AS v FROM w{i - 1} JOIN sym USING (node) JOIN deg USING (node) GROUP BY ALL)" for i in range(1, SERIES)) + " SELECT source, node, round(sum(v), 8) AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(SERIES)) + ") x GROUP BY source, node")
def _(spark, d):
    return rounded(diffusion.heat_kernel(_net(spark, d), _few(spark, d), 0.5), "value")


@query("mean_cliqueness_within", "WITH " + NET.replace("l_quantity >= 45", "l_quantity >= 30") + """, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part), e AS (SELECT a.cluster, src, dst FROM net JOIN c a ON a.node = src JOIN c b ON b.node = dst AND a.cluster = b.cluster),
s AS (SELECT cluster, src AS node, dst AS neighbour FROM e UNION ALL SELECT cluster, dst, src FROM e), g AS (SELECT cluster, node, count(*) AS degree FROM s GROUP BY ALL),
t AS (SELECT x.cluster, x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.cluster = y.cluster AND x.dst = y.src JOIN e z ON z.cluster = x.cluster AND z.src = x.src AND z.dst = y.dst),
k AS (SELECT cluster, node, count(*) AS t FROM (SELECT cluster, a AS node FROM t UNION ALL SELECT cluster, b FROM t UNION ALL SELECT cluster, c FROM t) x GROUP BY ALL),
z AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster HAVING count(*) >= 6)
SELECT cluster, size, count(*) AS linked, round(avg(CASE WHEN degree = 1 THEN 1.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END), 8) AS cliqueness FROM g JOIN z USING (cluster) LEFT JOIN k USING (cluster, node) GROUP BY ALL""")
def _(spark, d):
    return rounded(network.cluster_cliqueness(_net(spark, d, 30), _brands(spark, d)), "cliqueness")


@query("cluster_cliqueness", "WITH " + NET.replace("l_quantity >= 45", "l_quantity >= 30") + """, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part), e AS (SELECT a.cluster, src, dst FROM net JOIN c a ON a.node = src JOIN c b ON b.node = dst AND a.cluster = b.cluster),
s AS (SELECT cluster, src AS node, dst AS neighbour FROM e UNION ALL SELECT cluster, dst, src FROM e), g AS (SELECT cluster, node, count(*) AS degree FROM s GROUP BY ALL),
t AS (SELECT x.cluster, x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.cluster = y.cluster AND x.dst = y.src JOIN e z ON z.cluster = x.cluster AND z.src = x.src AND z.dst = y.dst),
k AS (SELECT cluster, node, count(*) AS t FROM (SELECT cluster, a AS node FROM t UNION ALL SELECT cluster, b FROM t UNION ALL SELECT cluster, c FROM t) x GROUP BY ALL)
SELECT cluster, node, degree, round(CASE WHEN degree = 1 THEN 1.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END, 8)::DOUBLE AS cliqueness FROM g LEFT JOIN k USING (cluster, node)""")
def _(spark, d):
    inner = network.within_clusters(_net(spark, d, 30), _brands(spark, d)).select("src", "dst")
    brand = _brands(spark, d)
    return rounded(network.clustering_coefficient(inner).join(brand, "node").select("cluster", "node", "degree", "cliqueness"), "cliqueness")


@query("distinct_grown_components")
def _(spark, d):
    found = motifs.grow_components(_net(spark, d), _centred_scores(spark, d), _few(spark, d))
    return rounded(motifs.distinct_components(found).select(F.array_join("members", ",").alias("members"), "size", "score", "rank"), "score")


@query("permuted_networks", f"WITH {NET} SELECT perm::INT AS perm, node, degree, 0::BIGINT AS repeated FROM deg, range(3) t(perm)")
def _(spark, d):
    """Three networks written and read back: every node keeps its degree, and no edge comes twice."""
    path = shared_path(spark, "permuted")
    random_nets.write_permuted(cut(_net(spark, d)), path, 3, rounds=3)
    ends = F.split("value", "\t")
    back = cut(spark.read.text(path).select("perm", ends[0].cast("long").alias("src"), ends[1].cast("long").alias("dst")))
    repeated = back.groupBy("perm", "src", "dst").count().groupBy("perm").agg(F.sum(F.col("count") - 1).alias("repeated"))
    per = back.select("perm", F.explode(F.array("src", "dst")).alias("node")).groupBy("perm", "node").agg(F.count(F.lit(1)).alias("degree"))
    return per.join(repeated, "perm").select(F.col("perm").cast("int").alias("perm"), "node", "degree", "repeated")

