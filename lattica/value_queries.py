"""Queries of single values: names, positions, predicates, statistics and matrix rows, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import special as sp
from lattica.functions import stats as st
from lattica.operators import expression, mutation, network, ontology
from lattica.queries import MAT, NET, ONTO, _annotation, _hierarchy, _matrix, _net, query, rounded
from lattica.session import shared_path, table
from lattica.sources import readers, writers


@query("barcode_samples", "SELECT l_orderkey, l_linenumber, substr(md5(l_orderkey::VARCHAR), 1, 12) AS sample, md5(l_orderkey::VARCHAR) AS barcode FROM lineitem")
def _(spark, d):
    barcode = F.md5(F.col("l_orderkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mutation.sample_name(barcode).alias("sample"), mutation.sample_name(barcode, None).alias("barcode"))


CHANGE = "CASE l_linenumber % 4 WHEN 0 THEN 'p.V' || l_partkey || 'E' WHEN 1 THEN 'p.*' || l_partkey || '_' || l_suppkey WHEN 2 THEN 'c.' || l_partkey ELSE 'p.fs' END"


@query("residue_positions", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 IN (0, 1) THEN l_partkey::INT END AS residue FROM lineitem WHERE {CHANGE} IS NOT NULL")
def _(spark, d):
    """Amino-acid changes of four forms, two of which have a residue."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mutation.residue(F.expr(CHANGE)).alias("residue"))


VARIANT = "CASE l_linenumber WHEN 1 THEN 'Missense_Mutation' WHEN 2 THEN 'SILENT' WHEN 3 THEN 'Frame_Shift_Del' WHEN 4 THEN 'Intron' WHEN 5 THEN 'splice_site' ELSE 'RNA' END"


@query("allowed_variants", f"SELECT variant, count(*) AS mutations, count(*) FILTER (variant IN ('Missense_Mutation', 'Frame_Shift_Del', 'splice_site')) AS allowed FROM (SELECT {VARIANT} AS variant FROM lineitem) GROUP BY variant")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr(VARIANT).alias("variant"))
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("mutations"), F.count_if(mutation.is_allowed(F.col("variant"))).alias("allowed"))


@query("homozygous_genes", "SELECT l_suppkey AS sample, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS genes FROM lineitem WHERE l_returnflag <> l_linestatus AND l_returnflag <> 'N' GROUP BY l_suppkey")
def _(spark, d):
    """Rows whose two alleles, a flag and N, both differ from the reference, a status."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").cast("string").alias("gene"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("allele1"), F.lit("N").alias("allele2"), F.lit("missense_mutation").alias("variant"))
    return mutation.genes_by_sample(mutation.homozygous(li), ["missense_mutation"]).select("sample", F.array_join("genes", ",").alias("genes"))


@query("chromosome_files", "SELECT s_suppkey, CASE WHEN s_suppkey % 25 = 23 THEN 'X' ELSE (s_suppkey % 25)::VARCHAR END AS chromosome FROM supplier WHERE s_suppkey % 25 > 0")
def _(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 25 > 0").withColumn("c", F.when(F.col("s_suppkey") % 25 == 23, "X").otherwise(F.lpad((F.col("s_suppkey") % 25).cast("string"), 2, "0")))
    return s.select("s_suppkey", readers.chromosome_of(F.concat(F.lit("/data/chr"), "c", F.lit(".table.txt"))).alias("chromosome"))


@query("logarithms", "SELECT p_partkey, round(log2(p_retailprice), 8) AS base2, round(ln(p_retailprice), 8) AS natural FROM part")
def _(spark, d):
    price = F.col("p_retailprice")
    return rounded(table(spark, d, "part").select("p_partkey", st.log2(price).alias("base2"), st.log2(price, "reference").alias("natural")), "base2", "natural")


X2 = "(p_retailprice / 100)"


@query("chi_square_shares", f"SELECT p_partkey, round(1 - exp(-{X2} / 2), 8) AS two, round(1 - exp(-{X2} / 2) * (1 + {X2} / 2), 8) AS four, round(exp(-{X2} / 2) * (1 + {X2} / 2 + {X2} * {X2} / 8), 8) AS tail_six FROM part")
def _(spark, d):
    """Cumulated shares of even degrees of freedom, which have closed forms."""
    x = F.col("p_retailprice") / 100
    return rounded(table(spark, d, "part").select("p_partkey", sp.chi_square_cdf(2, x).alias("two"), sp.chi_square_cdf(4, x).alias("four"), sp.chi_square_tail(6, x).alias("tail_six")), "two", "four", "tail_six")


@query("enrichment_ratios", "WITH n AS (SELECT p_type, count(*)::DOUBLE / (SELECT count(*) FROM part) AS ratio FROM part GROUP BY p_type), s AS (SELECT p_brand, p_type, count(*) AS success FROM part GROUP BY p_brand, p_type), b AS (SELECT *, sum(success) OVER (PARTITION BY p_brand) AS n FROM s) SELECT p_brand, p_type, round(success / b.n / ratio, 8)::DOUBLE AS enrichment FROM b JOIN n USING (p_type)")
def _(spark, d):
    p = table(spark, d, "part")
    total = p.agg(F.count(F.lit(1)).alias("total"))
    ratio = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(total)).select("p_type", (F.col("k") / F.col("total")).alias("ratio"))
    success = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("success")).join(p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand")
    return rounded(success.join(ratio, "p_type").select("p_brand", "p_type", st.enrichment_ratio(F.col("ratio"), F.col("n"), F.col("success")).alias("enrichment")), "enrichment")


@query("cluster_vector_distance", "SELECT p_partkey AS part, round(((p_size % 2 <> p_partkey % 2)::INT * 3 + (p_size % 3 = 0)::INT * p_size)::DOUBLE / (3 + p_size + 5), 8) AS distance FROM part")
def _(spark, d):
    """Vectors over three clusters of 3, ``p_size`` and 5 members."""
    a = F.array(F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.lit(True))
    b = F.array(F.col("p_partkey") % 2 == 0, F.lit(False), F.lit(True))
    sizes = F.array(F.lit(3).cast("long"), F.col("p_size").cast("long"), F.lit(5).cast("long"))
    return rounded(table(spark, d, "part").select(F.col("p_partkey").alias("part"), st.network_distance(a, b, sizes).alias("distance")), "distance")


@query("enrichment_lines", "SELECT p_brand || chr(9) || printf('%.4f', count(*) / 1000.0) || chr(9) || count(*) || chr(9) || min(p_size) || chr(9) || printf('%.4e', 0.25) || chr(9) || printf('%.4e', 0.5) || chr(9) || string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS line FROM part GROUP BY p_brand")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("hits"), F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")).alias("keys"))
    return p.select(writers.enrichment_line(F.col("p_brand"), F.col("n") / 1000.0, F.col("n"), F.col("hits"), F.lit(0.25), F.lit(0.5), F.col("keys")).alias("line"))


@query("arrow_keys", f"WITH {NET} SELECT src, dst, src || '->' || dst AS key FROM net")
def _(spark, d):
    return _net(spark, d).select("src", "dst", network.edge_key(F.col("dst"), F.col("src"), "->").alias("key"))


@query("appended_matrix", f"WITH {MAT} SELECT 'a' || feature AS feature, sample, round(value, 8) AS value FROM mat UNION ALL SELECT 'b' || feature, sample, round(-value, 8) FROM mat")
def _(spark, d):
    m = _matrix(spark, d)
    name = lambda tag: F.concat(F.lit(tag), F.col("feature").cast("string")).alias("feature")
    return rounded(expression.append(m.select(name("a"), "sample", "value"), m.select(name("b"), "sample", (-F.col("value")).alias("value"))), "value")


@query("selected_features", f"WITH {MAT} SELECT feature, sample, round(value, 8) AS value, CASE feature WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END::INT AS position FROM mat WHERE feature IN (7, 3, 5)")
def _(spark, d):
    return rounded(expression.select_features(_matrix(spark, d), [7, 3, 5]), "value").select("feature", "sample", "value", "position")


@query("read_pair_map", "SELECT c_nationkey::VARCHAR AS key, max(c_custkey)::VARCHAR AS value FROM customer WHERE c_custkey <> c_nationkey GROUP BY c_nationkey")
def _(spark, d):
    """The second field as key, self pairs left out, the last line of a key wins."""
    path = shared_path(spark, "pairs")
    rows = table(spark, d, "customer").coalesce(1).sortWithinPartitions("c_custkey")
    rows.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))).write.text(path)
    return readers.last_map(spark, path, key_first=False, drop_self=True)


@query("ontology_children", f"WITH {ONTO} SELECT DISTINCT parent AS root, child AS term, 1 AS depth FROM onto")
def _(spark, d):
    h = _hierarchy(spark, d)
    return ontology.descendants(h, h.select(F.col("parent").alias("root")).distinct(), recursive=False)


@query("ontology_subset", f"WITH {ONTO} SELECT child, parent FROM onto WHERE parent IN ('r1', 'r3') OR parent IN (SELECT child FROM onto WHERE parent IN ('r1', 'r3'))")
def _(spark, d):
    h = _hierarchy(spark, d)
    return ontology.subset(h, spark.createDataFrame([("r1",), ("r3",)], "root string"))


@query("term_pairs", "WITH a AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS term FROM lineitem WHERE l_quantity >= 45) SELECT x.term AS first, y.term AS second, count(*) AS shared FROM a x JOIN a y ON x.key = y.key AND x.term < y.term GROUP BY ALL")
def _(spark, d):
    """How many parts every two suppliers share."""
    a = _annotation(spark, d)
    x, y = a.select("key", F.col("term").alias("first")), a.select("key", F.col("term").alias("second"))
    return x.join(y, "key").where("first < second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared"))
