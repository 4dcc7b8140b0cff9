import math

import pytest
from pyspark.sql import functions as F

from lattica.functions import special as sp
from lattica.functions import stats as st
from lattica.operators import expression, mutation
from lattica.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tails(spark):
    assert one(spark, sp.binomial_tail(F.lit(0.1), F.lit(50), F.lit(7))) == pytest.approx(sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(7, 51)))
    assert one(spark, sp.binomial_tail(F.lit(0.3), F.lit(9), F.lit(0))) == pytest.approx(1 - 0.7**9)
    assert one(spark, sp.hypergeometric_tail(F.lit(50), F.lit(10), F.lit(20), F.lit(6))) == pytest.approx(sum(math.comb(10, i) * math.comb(40, 20 - i) for i in range(6, 11)) / math.comb(50, 20))
    assert one(spark, sp.fisher_two_tailed(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) == pytest.approx(34 / 70)
    assert one(spark, sp.fisher_cumulative(F.lit(1), F.lit(3), F.lit(3), F.lit(1))) == pytest.approx(17 / 70)


def _binomial(n, p, k, high):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, min(n, high) + 1))


def test_tails_take_the_terms_that_count(spark):
    """A billion draws are no longer a billion terms, and what is left out does not show."""
    poisson = 1 - math.fsum(math.exp(-20 + i * math.log(20) - math.lgamma(i + 1)) for i in range(35))
    assert one(spark, sp.binomial_tail(F.lit(2e-8), F.lit(1_000_000_000), F.lit(35))) == pytest.approx(poisson, rel=1e-4)
    assert one(spark, sp.hypergeometric_tail(F.lit(2_000_000_000), F.lit(40), F.lit(1_000_000_000), F.lit(21))) == pytest.approx(_binomial(40, 0.5, 21, 40), rel=1e-4)
    assert one(spark, sp.hypergeometric_tail(F.lit(2_000_000_000), F.lit(1_000_000_000), F.lit(1_000_000_000), F.lit(500_000_000))) == pytest.approx(0.5, abs=1e-4)
    for n, p, k in ((5000, 0.4, 1), (5000, 0.4, 1990), (5000, 0.4, 2300), (5000, 0.999, 4990), (200_000, 6e-5, 3), (200_000, 6e-5, 60)):
        assert one(spark, sp.binomial_tail(F.lit(p), F.lit(n), F.lit(k))) == pytest.approx(_binomial(n, p, k, 6000), rel=1e-9)


def test_more_drawn_than_there_are(spark):
    """No such draw: not the surest of all findings (0), but none."""
    assert one(spark, sp.hypergeometric_tail(F.lit(50), F.lit(10), F.lit(51), F.lit(6))) == 1.0
    assert one(spark, sp.hypergeometric_tail(F.lit(50), F.lit(51), F.lit(20), F.lit(6))) == 1.0
    assert one(spark, sp.hypergeometric_tail(F.lit(50), F.lit(10), F.lit(50), F.lit(6))) == pytest.approx(1.0)
    assert one(spark, sp.hypergeometric_tail(F.lit(50), F.lit(10), F.lit(20), F.lit(11))) == 0.0


def test_gamma_of_many_degrees(spark):
    """Three hundred steps were too few from about a thousand degrees of freedom on; an even number has a finite sum."""
    for a in (3, 30, 3000, 30_000):
        for x in (0.9 * a, a - 1.0, a + 1.5, a + 2 * math.sqrt(a), 3.0 * a):
            upper = math.fsum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(a))
            assert one(spark, sp.gamma_q(F.lit(float(a)), F.lit(x))) == pytest.approx(upper, rel=1e-7)
            assert one(spark, sp.gamma_q(a, F.lit(x))) == pytest.approx(upper, rel=1e-7)
            assert one(spark, sp.gamma_p(a, F.lit(x))) == pytest.approx(1 - upper, abs=1e-8)


@pytest.mark.parametrize("z", [-8.0, -1.96, 0.3, 2.5, 6.0])
def test_normal(spark, z):
    assert one(spark, sp.normal_cdf(F.lit(z))) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-9)
    assert one(spark, sp.normal_two_tailed(F.lit(z))) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)


def test_t_and_chi_square(spark):
    assert one(spark, sp.t_two_tailed(F.lit(1.0), F.lit(1.0))) == pytest.approx(0.5)
    assert one(spark, sp.t_two_tailed(F.lit(2.0), F.lit(2.0))) == pytest.approx(1 - 2 / math.sqrt(6))
    assert one(spark, sp.chi_square_tail(4.0, F.lit(7.0))) == pytest.approx(math.exp(-3.5) * 4.5)
    assert one(spark, sp.chi_square_cdf(4.0, F.lit(7.0))) == pytest.approx(1 - math.exp(-3.5) * 4.5)


def test_false_discovery_rates(spark):
    p = spark.createDataFrame([(x,) for x in (0.01, 0.02, 0.03, 0.5)], "p double")
    assert [r["fdr"] for r in st.benjamini_hochberg(p, "p").orderBy("rank").collect()] == pytest.approx([0.04, 0.04, 0.04, 0.5])
    assert [r["fdr"] for r in st.benjamini_hochberg(p, "p", mode="reference").orderBy("rank").collect()] == pytest.approx([0.03, 0.03, 0.03, 0.5])


def test_combined(spark):
    t = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.0)], "g string, p double")
    got = {r["g"]: r["combined"] for r in st.combine_p_values(t, "g", "p").collect()}
    x = -2 * math.log(0.02)
    assert got["a"] == pytest.approx(math.exp(-x / 2) * (1 + x / 2)) and got["b"] is None


def test_vectors(spark):
    df = spark.createDataFrame([([1, 2], [4, 6], ["x", "y"], ["y", "z", "z"])], "a array<int>, b array<int>, s array<string>, t array<string>")
    r = df.select(st.euclidean(F.col("a"), F.col("b")).alias("e"), st.hamming(F.col("a"), F.col("b")).alias("h"), st.jaccard(F.col("s"), F.col("t")).alias("j"), st.overlap(F.col("s"), F.col("t")).alias("o")).first()
    assert (r["e"], r["h"], r["j"], r["o"]) == (5.0, 2.0, pytest.approx(1 / 3), 0.5)


def matrix(spark):
    return spark.createDataFrame([("a", "s1", 1.0), ("b", "s1", 3.0), ("c", "s1", 3.0), ("a", "s2", 2.0), ("b", "s2", None)], "feature string, sample string, value double")


def test_matrix_transforms(spark):
    m = matrix(spark)
    rank = {(r["feature"], r["sample"]): r["value"] for r in expression.rank_by_sample(m).collect()}
    assert rank["b", "s1"] == rank["c", "s1"] == pytest.approx(1 / 3) and rank["a", "s1"] == 1.0
    assert {r["value"] for r in expression.centre_by_feature(m).where("feature = 'a'").collect()} == {-0.5, 0.5}
    assert expression.select_features(m, ["b", "a"]).where("position = 0").count() == 2
    with pytest.raises(KeyError):
        expression.select_features(m, ["q"])
    with pytest.raises(ValueError):
        expression.append(m, m.where("sample = 's1'"))
    assert expression.to_long(expression.to_wide(m, ["s1", "s2"])).count() == 4
    flat = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", 1.0), ("b", "s1", 1.0), ("b", "s2", 5.0)], "feature string, sample string, value double")
    assert expression.edge_correlation(flat, spark.createDataFrame([("a", "b")], "src string, dst string")).first()["correlation"] == 1.0


def test_mutations(spark):
    assert one(spark, mutation.residue(F.lit("p.R132H"))) == 132 and one(spark, mutation.residue(F.lit("c.12A"))) is None
    key = lambda *a: one(spark, mutation.score_key(*[F.lit(x) for x in a]))
    assert key("7", 5, "A", "A", "T") == "hg19,7,5,A,T" and key("7", 5, "A", "T", "T") == "hg19,7,5,A,T" and key("7", 5, "A", "A", "A") is None
    maf = spark.createDataFrame([("s", "g", "Nonsense_Mutation", "1"), ("s", "h", "Missense_Mutation", "2.5"), ("s", "h", "Missense_Mutation", "bad")], "sample string, gene string, variant string, score string")
    got = {r["gene"]: r["score"] for r in mutation.score_by_sample_gene(maf, ["nonsense_mutation"]).collect()}
    assert got == {"g": 2.5, "h": 2.5}
    assert mutation.genes_by_sample(maf, mutation.ALLOWED).first()["genes"] == ["g", "h"]
    sites = spark.createDataFrame([("s", "g", 0), ("s", "g", 1), ("s", "g", 9)], "sample string, gene string, position int")
    lengths = spark.createDataFrame([("g", 3)], "gene string, length int")
    assert mutation.site_vector(mutation.site_frequency(sites, lengths), lengths).first()["counts"] == [2, 0, 0]


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert readers.interactions(spark, put("e", "a\tb\na\tb\nb\tc\n")).count() == 2
    assert readers.interactions(spark, put("e2", "a\tb\na\tb\nb\tc\n"), limit=2).count() == 1
    assert readers.sif(spark, put("s", "b\tpp\ta\na\tpp\tb\n")).collect()[0]["src"] == "a"
    assert {r["key"]: r["terms"] for r in readers.key_sets(spark, put("k", "x\tt\nx\tu\ny\tt\n")).collect()} == {"x": ["t", "u"], "y": ["t"]}
    assert {r["key"]: r["value"] for r in readers.last_map(spark, put("m", "x\t1\ny\ty\nx\t2\n"), drop_self=True).collect()} == {"x": "2"}
    assert readers.clusters(spark, put("c", "a\tb\tc\nd\n"), 2).count() == 3
    go = put("g", "!c\nd\tP1\t\t\tGO:1\t\t\t\tP\nd\tP2\t\t\tGO:0008150\t\t\t\tP\nd\tP3\t\t\tGO:3\t\t\t\tF\n")
    assert [r["key"] for r in readers.gene_ontology(spark, go, "P").collect()] == ["P1"]
    m = readers.matrix(spark, put("x", 'id\t"s1"\ts2\ng\t1\t2\nh\tNA\t3\ng\t5\t\n'))
    assert [(r["feature"], r["sample"], r["value"]) for r in m.collect()] == [("g", "s1", 5.0)]
    assert readers.clinical(spark, put("cl", "id\tt\na\t1\nb\tNA\n"), "t", numeric=True).collect()[0]["value"] == 1.0
    assert readers.scores(spark, put("sc", "k\tx\ts\na\tq\t1.5\nb\t2\n")).collect()[0]["score"] == 1.5
    up = put("u", "ID   A\nGN   Name=TP53 {ECO:1}; Synonyms=P53, X1;\nSQ   SEQUENCE   393 AA;  1 MW\n//\nID   B\nGN   Name=P53;\nSQ   SEQUENCE   10 AA;  1 MW\n//\n")
    assert {r["gene"]: r["length"] for r in readers.protein_lengths(spark, up).collect()} == {"TP53": 393, "P53": 393, "X1": 393}
    terms, e = readers.ontology(spark, put("o", "A\ta\troot_node\t\tdef\nB\tb\tA\t\tx\n"))
    assert terms.count() == 2 and e.collect()[0]["parent"] == "A"
    assert {r["pair"]: r["edges"] for r in readers.path_report(spark, put("p", "a->b:\n[a c, c b]\na->d:\nnull\n")).collect()} == {"a->b": ["a c", "c b"], "a->d": []}
    d = {tuple(r["members"]): r["parent"] for r in readers.dendrogram(spark, put("d", "0.1\ta,b\n0.2\tc,d\n0.5\ta,b,c,d\n")).collect()}
    assert d[("a", "b")] == d[("c", "d")] is not None and d[("a", "b", "c", "d")] is None
    assert readers.dense_matrix(spark, put("dm", "1\t2\n3\t4\n")).agg(F.sum("value")).first()[0] == 10
    b = readers.base64_files(spark, put("bin", "hi?>")).select(readers.from_base64(F.col("encoded")).cast("string").alias("x")).first()["x"]
    assert b == "hi?>"
    xml = put("gd.xml", "<R><GeneEntry><HUGOGeneSymbol>TP53</HUGOGeneSymbol><Sentence><DiseaseData><NCIDiseaseConceptCode>C1</NCIDiseaseConceptCode></DiseaseData><NegationIndicator>no</NegationIndicator><SentenceStatusFlag>finished</SentenceStatusFlag></Sentence></GeneEntry></R>")
    assert [tuple(r) for r in readers.gene_disease(spark, xml).collect()] == [("TP53", "C1")]


def test_writers_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    writers.write_map(e, "src", "dst", str(tmp_path / "e"), sort=True)
    assert readers.interactions(spark, str(tmp_path / "e")).exceptAll(e).count() == 0
    writers.write_matrix(matrix(spark), str(tmp_path / "m"))
    assert readers.matrix(spark, str(tmp_path / "m") + "/*.csv").count() == 4
    writers.write_indexed_network(e, str(tmp_path / "n"), str(tmp_path / "i"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "n")).collect()) == ["1 a", "2 b", "3 c"]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "i")).collect()) == ["1 2 1", "2 3 1"]
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "cluster int, node string")
    writers.write_clusters(c, str(tmp_path / "c"))
    assert readers.clusters(spark, str(tmp_path / "c"), 2).count() == 2
    assert writers.histogram(matrix(spark).where("value is not null"), "value", 2).agg(F.sum("n")).first()[0] == 4
    assert one(spark, writers.file_name(F.lit("a (b)/c&d"))) == "a__b__c_d"
