"""Queries that write a file layout from the test tables and read it back: readers and writers against SQL on the tables.

Files go to a new folder under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import network
from lattica.queries import ANN, DAYS, NET, _annotation, _brands, _days, _net, query, rounded
from lattica.session import cut, shared_path, table
from lattica.sources import readers, writers


def _lines(spark, df, name: str, one_file: bool = False) -> str:
    """``df``'s only column as lines of a new file folder."""
    path = shared_path(spark, name)
    (df.coalesce(1) if one_file else df).write.text(path)
    return path


def _fields(*columns) -> F.Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


@query("read_line_set", "SELECT DISTINCT p_type AS value FROM part")
def _(spark, d):
    path = shared_path(spark, "lines")
    writers.write_lines(table(spark, d, "part"), "p_type", path, sort=True)
    return readers.line_set(spark, path)


@query("read_interactions", f"WITH {NET} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM net")
def _(spark, d):
    return readers.interactions(spark, _lines(spark, _net(spark, d).select(_fields("src", "dst")), "pairs"))


@query("read_sif", f"WITH {NET} SELECT least(src::VARCHAR, dst::VARCHAR) AS src, greatest(src::VARCHAR, dst::VARCHAR) AS dst FROM net")
def _(spark, d):
    net = _net(spark, d)
    both = net.union(net.select(F.col("dst"), F.col("src")))
    return readers.sif(spark, _lines(spark, both.select(_fields("src", F.lit("FI"), "dst")), "sif"))


@query("read_key_terms", f"WITH {ANN} SELECT key::VARCHAR AS key, term::VARCHAR AS term FROM ann")
def _(spark, d):
    path = shared_path(spark, "map")
    writers.write_map(_annotation(spark, d), "key", "term", path)
    return readers.key_terms(spark, path)


@query("read_key_sets", f"WITH {ANN} SELECT term::VARCHAR AS key, string_agg(key::VARCHAR, ',' ORDER BY key::VARCHAR) AS terms FROM ann GROUP BY term")
def _(spark, d):
    path = shared_path(spark, "sets")
    writers.write_map(_annotation(spark, d).groupBy("key").agg(F.collect_set("term").alias("terms")), "key", "terms", path)
    return readers.key_sets(spark, path, key_first=False).select("key", F.array_join("terms", ",").alias("terms"))


@query("read_last_map", "SELECT n_regionkey::VARCHAR AS key, max_by(n_name, n_nationkey) AS value FROM nation GROUP BY n_regionkey")
def _(spark, d):
    n = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return readers.last_map(spark, _lines(spark, n.select(_fields("n_regionkey", "n_name")), "last", True))


@query("read_pair_nodes", f"WITH {NET} SELECT DISTINCT src::VARCHAR AS node FROM net")
def _(spark, d):
    return readers.pair_terms(spark, _lines(spark, _net(spark, d).select(_fields("src", "dst")), "side"), side=0)


@query("read_clusters", "SELECT string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS members, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 5")
def _(spark, d):
    path = shared_path(spark, "clusters")
    writers.write_clusters(_brands(spark, d), path)
    c = readers.clusters(spark, path, least=5).groupBy("cluster").agg(F.array_sort(F.collect_set("node")).alias("m"))
    return c.select(F.array_join("m", ",").alias("members"), F.size("m").cast("long").alias("n"))


@query("read_gene_ontology", f"WITH {ANN} SELECT key::VARCHAR AS key, 'GO:' || term::VARCHAR AS term FROM ann WHERE key % 3 = 1")
def _(spark, d):
    a = _annotation(spark, d)
    aspect = F.element_at(F.array(F.lit("P"), F.lit("F"), F.lit("C")), (F.col("key") % 3 + 1).cast("int"))
    x = F.lit("x")
    rows = a.select(_fields(x, "key", x, x, F.concat(F.lit("GO:"), F.col("term").cast("string")), x, x, x, aspect).alias("value"))
    roots = a.select(_fields(x, "key", x, x, F.lit(readers.ONTOLOGY_ROOTS[0]), x, x, x, aspect)).union(a.select(F.lit("! a comment")))
    return readers.gene_ontology(spark, _lines(spark, rows.union(roots), "go"), aspect="F")


@query("read_ontology_names", f"WITH {ANN} SELECT key, term::VARCHAR AS term, s_name AS name FROM ann LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = term")
def _(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(_fields("s_suppkey", "s_name").alias("value"))
    names = readers.ontology_names(spark, _lines(spark, s.union(spark.createDataFrame([("! comment",)], "value string")), "names"))
    return readers.with_names(_annotation(spark, d).withColumn("term", F.col("term").cast("string")), names).select("key", "term", "name")


@query("renamed_keys", f"WITH {ANN} SELECT DISTINCT p_brand AS key, term FROM ann JOIN part ON p_partkey = key")
def _(spark, d):
    return readers.renamed_keys(_annotation(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("name")))


@query("read_matrix", f"WITH {DAYS} SELECT feature, sample, round(value, 6) AS value FROM days")
def _(spark, d):
    path = shared_path(spark, "matrix")
    writers.write_matrix(_days(spark, d), path)
    return rounded(readers.matrix(spark, path), "value", digits=6)


@query("read_phenotypes", "SELECT c_name AS sample, c_mktsegment AS type FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(_fields("c_name", F.lit("x"), F.lit("y"), "c_mktsegment").alias("value"))
    return readers.phenotypes(spark, _lines(spark, c.union(spark.createDataFrame([("#x\ta\tb\tc",), ("PID\ta\tb\tc",)], "value string")), "types"))


@query("read_clinical", "SELECT c_name AS sample, round(c_acctbal, 2) AS value FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, d):
    path = shared_path(spark, "clinical")
    c = table(spark, d, "customer").select("c_name", "c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal").cast("string")).otherwise("NA").alias("OS"))
    c.write.option("header", True).option("sep", "\t").csv(path)
    return rounded(readers.clinical(spark, path, "OS", numeric=True), "value", digits=2)


@query("read_scores", "SELECT p_partkey::VARCHAR AS key, round(p_retailprice, 4) AS score FROM part")
def _(spark, d):
    path = shared_path(spark, "scores")
    table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice").coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return rounded(readers.scores(spark, path), "score", digits=4)


@query("read_numbers", "SELECT round(s_acctbal, 2) AS value FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_acctbal").cast("string").alias("value")).union(spark.createDataFrame([("not a number",), ("",)], "value string"))
    return rounded(readers.numbers(spark, _lines(spark, s, "numbers")), "value", digits=2)


@query("read_protein_lengths", "SELECT p_brand AS gene, max(100 + p_size)::INT AS length FROM part GROUP BY p_brand UNION ALL SELECT p_type, max(100 + p_size)::INT FROM part GROUP BY p_type")
def _(spark, d):
    p = table(spark, d, "part")
    entry = F.concat(F.lit("ID   x\nGN   Name="), "p_brand", F.lit("; Synonyms="), "p_type", F.lit(";\nSQ   SEQUENCE   "), (F.col("p_size") + 100).cast("string"), F.lit(" AA;  1 MW;\n     MKV\n//"))
    return readers.protein_lengths(spark, _lines(spark, p.select(entry), "flat"))


@query("read_dense_matrix", "SELECT a.r_regionkey AS i, b.r_regionkey AS j, (a.r_regionkey * 10 + b.r_regionkey)::DOUBLE AS value FROM region a, region b")
def _(spark, d):
    r = table(spark, d, "region").select("r_regionkey")
    cells = r.select(F.col("r_regionkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).withColumn("value", (F.col("i") * 10 + F.col("j")).cast("double"))
    path = shared_path(spark, "dense")
    writers.write_dense(cells.coalesce(1), path)
    return readers.dense_matrix(spark, path).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value")


@query("read_topic_counts", "SELECT p_type AS topic, p_brand AS id, count(*)::INT AS n FROM part GROUP BY ALL")
def _(spark, d):
    path = shared_path(spark, "topics")
    table(spark, d, "part").groupBy("p_type", "p_brand").count().write.option("header", True).option("sep", "\t").csv(path)
    return readers.topic_counts(spark, path)


@query("read_ontology", "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(_fields(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"), F.lit("x"), F.lit("about")))
    r = table(spark, d, "region").select(_fields(F.concat(F.lit("r"), "r_regionkey"), "r_name", F.lit("root_node"), F.lit("x"), F.lit("about")))
    return readers.ontology(spark, _lines(spark, n.union(r), "ontology"))[1]


@query("read_gene_disease", "SELECT DISTINCT p_brand AS gene, 'C' || p_size AS disease FROM part WHERE p_size % 2 = 0")
def _(spark, d):
    flag = F.when(F.col("p_size") % 2 == 0, "no").otherwise("yes")
    sentence = F.concat(F.lit("<Sentence><DiseaseData><NCIDiseaseConceptCode>C"), F.col("p_size").cast("string"), F.lit("</NCIDiseaseConceptCode></DiseaseData><NegationIndicator>"), flag, F.lit("</NegationIndicator><SentenceStatusFlag>finished</SentenceStatusFlag></Sentence>"))
    entry = F.concat(F.lit("<GeneEntry><HUGOGeneSymbol>"), "p_brand", F.lit("</HUGOGeneSymbol>"), sentence, F.lit("</GeneEntry>"))
    files = table(spark, d, "part").select("p_brand", entry.alias("e")).groupBy("p_brand").agg(F.concat(F.lit("<Entries>"), F.array_join(F.collect_list("e"), ""), F.lit("</Entries>")).alias("value"))
    path = shared_path(spark, "diseases")
    files.write.partitionBy("p_brand").text(path)  # a whole document a file
    return readers.gene_disease(spark, path)


@query("read_path_report", "SELECT n_name || '->' || n_regionkey AS pair, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey || ' a;' || n_nationkey || ' b' ELSE '' END AS edges FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(
        F.concat("n_name", F.lit("->"), "n_regionkey", F.lit(":\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("["), "n_nationkey", F.lit(" a, "), "n_nationkey", F.lit(" b]"))).otherwise("null"))
    )
    return readers.path_report(spark, _lines(spark, n, "report", True)).select("pair", F.array_join("edges", ";").alias("edges"))


@query("read_dendrogram", "SELECT r_regionkey::INT AS step, (r_regionkey + 1)::DOUBLE AS distance, (r_regionkey + 2)::INT AS members, CASE WHEN r_regionkey < 4 THEN r_regionkey + 1 END::INT AS parent FROM region")
def _(spark, d):
    r = table(spark, d, "region").coalesce(1).sortWithinPartitions("r_regionkey")
    rows = r.select(_fields((F.col("r_regionkey") + 1).cast("string"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("r_regionkey") + 1), lambda x: x.cast("string")), ",")))
    t = cut(readers.dendrogram(spark, _lines(spark, rows, "tree", True)))
    first = t.agg(F.min("at").alias("first"))
    return t.crossJoin(F.broadcast(first)).select((F.col("at") - F.col("first")).cast("int").alias("step"), "distance", F.size("members").alias("members"), (F.col("parent") - F.col("first")).cast("int").alias("parent"))


@query("read_base64", "SELECT n_name AS value FROM nation")
def _(spark, d):
    found = readers.base64_files(spark, _lines(spark, table(spark, d, "nation").select("n_name"), "binary") + "/part-*")
    return found.select(F.explode(F.split(readers.from_base64(F.col("encoded")).cast("string"), "\n")).alias("value")).where("value <> ''")


@query("write_attributes", "SELECT 'size (class=Integer)' AS value UNION ALL SELECT p_partkey || '=' || p_size FROM part")
def _(spark, d):
    path = shared_path(spark, "attributes")
    writers.write_attributes(table(spark, d, "part"), "p_partkey", "p_size", "size", "Integer", path)
    return readers.lines(spark, path)


INDEX = f"WITH {NET}, ix AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM deg)"


@query("write_indexed_network", f"{INDEX} SELECT i || ' ' || node AS value FROM ix UNION ALL SELECT a.i || ' ' || b.i || ' 1' FROM net JOIN ix a ON a.node = src JOIN ix b ON b.node = dst")
def _(spark, d):
    nodes, edges = shared_path(spark, "nodes"), shared_path(spark, "edges")
    writers.write_indexed_network(_net(spark, d), nodes, edges)
    return readers.lines(spark, nodes).union(readers.lines(spark, edges))


@query("write_sif_by_cluster", f"WITH {NET}, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part) SELECT a.cluster, src || chr(9) || 'FI' || chr(9) || dst AS value FROM net JOIN c a ON a.node = src JOIN c b ON b.node = dst AND a.cluster = b.cluster")
def _(spark, d):
    path = shared_path(spark, "by_cluster")
    writers.write_sif_by_cluster(network.within_clusters(_net(spark, d), _brands(spark, d)), path)
    return readers.lines(spark, path).select(F.col("cluster").cast("string").alias("cluster"), "value")


@query("score_histogram", "WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT least(floor((p_retailprice - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM part, s GROUP BY ALL")
def _(spark, d):
    return writers.histogram(table(spark, d, "part"), "p_retailprice", 20)


@query("score_box_summary", "SELECT p_type, round(min(p_retailprice), 6) AS low, round(quantile_cont(p_retailprice, 0.5), 6) AS middle, round(quantile_cont(p_retailprice, 0.75), 6) AS third, round(max(p_retailprice), 6) AS high FROM part GROUP BY p_type")
def _(spark, d):
    b = writers.box_summary(table(spark, d, "part"), "p_retailprice", ["p_type"])
    return rounded(b.select("p_type", F.col("q")[0].alias("low"), F.col("q")[2].alias("middle"), F.col("q")[3].alias("third"), F.col("q")[4].alias("high")), "low", "middle", "third", "high", digits=6)


@query("cleaned_names", "SELECT p_partkey, replace(p_name, ' ', '_') AS file, p_name AS plain, (p_partkey % 23)::VARCHAR AS chromosome FROM part WHERE p_partkey % 23 > 0")
def _(spark, d):
    p = table(spark, d, "part").where("p_partkey % 23 > 0")
    quoted = F.concat(F.lit('"'), "p_name", F.lit('"'))
    file = F.concat(F.lit("/data/chr0"), (F.col("p_partkey") % 23).cast("string"), F.lit(".fa.gz"))
    return p.select("p_partkey", writers.file_name(F.col("p_name")).alias("file"), writers.without_quotes(quoted).alias("plain"), readers.chromosome_of(file).alias("chromosome"))
