"""Readers of the text layouts that networks, annotations, matrices, clusters and ontologies come in.

All of them scan with Spark's own readers; parsing is column expressions. Paths may be anything Spark can open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.ranking import running_sums
from lattica.session import cut

# Ids of the three root terms of the gene ontology.
ONTOLOGY_ROOTS = ["GO:0003674", "GO:0008150", "GO:0005575"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def line_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Distinct lines ``(value)``; a limit counts lines before repeats fall away."""
    rows = lines(spark, path)
    return (rows.limit(limit) if limit is not None else rows).distinct()


def interactions(spark: SparkSession, path: str, sep: str = "\t", limit: int | None = None) -> DataFrame:
    """Distinct pairs ``(src, dst)`` as they are written."""
    parts = F.split("value", _literal(sep), 2)
    return line_set(spark, path, limit).select(parts[0].alias("src"), parts[1].alias("dst")).where("dst is not null")


def sif(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a three-column interaction file, smaller end first."""
    parts = F.split("value", "\t")
    rows = lines(spark, path).select(parts[0].alias("a"), F.get(parts, F.lit(2)).alias("b")).where("b is not null and a <> b")
    return rows.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def key_terms(spark: SparkSession, path: str, sep: str = "\t", key_first: bool = True) -> DataFrame:
    """Distinct many-to-many pairs ``(key, term)``; ``key_first=False`` takes the second field as key."""
    parts = F.split("value", _literal(sep), 2)
    a, b = (parts[0], parts[1]) if key_first else (parts[1], parts[0])
    return lines(spark, path).select(a.alias("key"), b.alias("term")).where("key is not null and term is not null").distinct()


def key_sets(spark: SparkSession, path: str, sep: str = "\t", key_first: bool = True) -> DataFrame:
    """``(key, terms)`` with sorted term sets."""
    return key_terms(spark, path, sep, key_first).groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an increasing number in file order, and the file."""
    return lines(spark, path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))


def last_map(spark: SparkSession, path: str, sep: str = "\t", key_first: bool = True, drop_self: bool = False, mode: str = "standard") -> DataFrame:
    """One-to-one map ``(key, value)`` in which the last line of a key wins.

    ``drop_self`` leaves pairs of equal ends out; in ``mode='reference'`` it has no effect, as in the replaced library.
    """
    parts = F.split("value", _literal(sep), 2)
    a, b = (parts[0], parts[1]) if key_first else (parts[1], parts[0])
    rows = _numbered(spark, path).select(a.alias("key"), b.alias("v"), "at").where("key is not null and v is not null")
    if drop_self and mode == "standard":
        rows = rows.where("key <> v")
    return rows.groupBy("key").agg(F.max_by("v", "at").alias("value"))


def pair_terms(spark: SparkSession, path: str, sep: str = "\t", side: int | None = None) -> DataFrame:
    """Distinct names of both fields, or of field 0 or 1 only."""
    e = interactions(spark, path, sep)
    if side is None:
        return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return e.select(F.col(["src", "dst"][side]).alias("node")).distinct()


def clusters(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """``(cluster, node)`` of ragged lines, one cluster a line; clusters of fewer than ``least`` members are left out."""
    rows = _numbered(spark, path).select(F.col("at").alias("cluster"), F.split("value", "\t").alias("m")).where(F.size("m") >= least)
    return rows.select("cluster", F.explode(F.array_distinct("m")).alias("node")).where("node <> ''")


def gene_ontology(spark: SparkSession, path: str, aspect: str | None = None) -> DataFrame:
    """``(key, term)`` of an annotation file: comment lines and root terms are left out; ``aspect`` is P, F or C."""
    parts = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").startswith("!")).select(parts[1].alias("key"), F.get(parts, F.lit(4)).alias("term"), F.get(parts, F.lit(8)).alias("aspect"))
    rows = rows.where(F.col("term").isNotNull() & ~F.col("term").isin(ONTOLOGY_ROOTS))
    return (rows if aspect is None else rows.where(F.col("aspect") == aspect)).select("key", "term").distinct()


def ontology_names(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return lines(spark, path).where(~F.col("value").startswith("!")).select(parts[0].alias("term"), parts[1].alias("name")).where("name is not null")


def with_names(annotation: DataFrame, names: DataFrame) -> DataFrame:
    """Annotation with the terms' names; terms without one keep a null."""
    return annotation.join(names, "term", "left")


def renamed_keys(annotation: DataFrame, names: DataFrame, mode: str = "standard") -> DataFrame:
    """Keys replaced by ``names(key, name)``; keys without a name are left out.

    Two keys of one name give the union of their terms; in ``mode='reference'`` the larger key's terms alone stay.
    """
    both = annotation.join(names, "key")
    if mode == "reference":
        last = both.groupBy("name").agg(F.max("key").alias("key"))
        both = both.join(last, ["name", "key"])
    return both.select(F.col("name").alias("key"), "term").distinct()


def matrix(spark: SparkSession, path: str, sep: str = "\t", drop_na_rows: bool = True) -> DataFrame:
    """Long form ``(feature, sample, value)`` of a matrix with a header line; the last line of a feature wins.

    Quotes fall away, empty and unreadable cells have no row; with ``drop_na_rows`` a line that holds ``NA`` after its
    first field is left out whole.
    """
    rows = _numbered(spark, path)
    head = rows.orderBy("at").limit(1).select("value").first()
    if head is None:
        return spark.createDataFrame([], "feature string, sample string, value double")
    samples = [s.strip('"') for s in head["value"].split(sep)]
    body = rows.where(F.col("value") != head["value"]).withColumn("p", F.split(F.regexp_replace("value", '"', ""), _literal(sep)))
    if drop_na_rows:
        body = body.where(~F.array_join(F.slice("p", 2, len(samples)), sep).contains("NA"))
    last = body.groupBy(F.col("p")[0].alias("feature")).agg(F.max_by("p", "at").alias("p"))
    cells = last.select("feature", F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in samples[1:]]).alias("sample"), F.slice("p", 2, len(samples)).alias("cell"))).alias("c"))
    return cells.select("feature", "c.sample", F.col("c.cell").try_cast("double").alias("value")).where("sample is not null and value is not null")


def phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, type)`` from the first and fourth fields; lines that start with # or PID are left out."""
    parts = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").rlike("^(#|PID)"))
    return rows.select(parts[0].alias("sample"), F.get(parts, F.lit(3)).alias("type")).where("type is not null")


def table_with_header(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def clinical(spark: SparkSession, path: str, column: str, numeric: bool = False) -> DataFrame:
    """``(sample, value)`` of a named column; empty cells and NA are left out. An unknown column is an error."""
    t = table_with_header(spark, path)
    if column not in t.columns:
        raise KeyError(column)
    value = F.col(f"`{column}`")
    out = t.select(F.col(f"`{t.columns[0]}`").alias("sample"), value.alias("value")).where("value is not null and value <> '' and upper(value) <> 'NA'")
    return out.withColumn("value", F.col("value").try_cast("double")) if numeric else out


def scores(spark: SparkSession, path: str) -> DataFrame:
    """``(key, score)`` from the first and last header columns; lines of another length are left out."""
    rows = _numbered(spark, path)
    head = rows.orderBy("at").limit(1).select("value").first()
    if head is None:
        return spark.createDataFrame([], "key string, score double")
    width = len(head["value"].split("\t"))
    p = F.split("value", "\t")
    return rows.where((F.col("value") != head["value"]) & (F.size(p) == width)).select(p[0].alias("key"), F.element_at(p, -1).try_cast("double").alias("score")).where("score is not null")


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("value").try_cast("double").alias("value")).where("value is not null")


def protein_lengths(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """``(gene, length)``: the longest sequence of every gene name and synonym of a protein flat file, entries ended by ``//``."""
    entries = spark.read.option("lineSep", "//\n").text(path)
    length = F.regexp_extract("value", r"SQ\s+SEQUENCE\s+(\d+)\s+AA", 1).try_cast("int")
    text = F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^GN\s+(.*)$"), F.lit(1)), " ")
    named = F.concat(F.regexp_extract_all(text, F.lit(r"Name=([^;{]+)"), F.lit(1)), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"Synonyms=([^;]+)"), F.lit(1)), lambda s: F.split(s, ","))))
    names = entries.select(F.explode(F.transform(named, lambda n: F.trim(F.regexp_replace(n, r"\{.*", "")))).alias("gene"), length.alias("length")).where("gene <> '' and length is not null")
    if aliases:
        names = names.replace(aliases, subset=["gene"])
    return names.groupBy("gene").agg(F.max("length").alias("length"))


def dense_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(i, j, value)`` of a square matrix without a header; a line of another width is an error when it is read."""
    rows = _numbered(spark, path).withColumn("i", F.row_number().over(Window.orderBy("at")) - 1)
    p = F.split("value", _literal(sep))
    first = rows.orderBy("at").limit(1).select(F.size(p).alias("n")).first()
    n = first["n"] if first else 0
    checked = F.when(F.size(p) == n, p).otherwise(F.raise_error(F.concat(F.lit("line of another width: "), F.col("i").cast("string"))))
    return rows.select("i", F.posexplode(checked).alias("j", "cell")).select("i", "j", F.col("cell").cast("double").alias("value"))


def topic_counts(spark: SparkSession, path: str) -> DataFrame:
    t = table_with_header(spark, path)
    a, b, c = t.columns[:3]
    return t.select(F.col(f"`{a}`").alias("topic"), F.col(f"`{b}`").alias("id"), F.col(f"`{c}`").cast("int").alias("n"))


def ontology(spark: SparkSession, path: str, root: str = "root_node") -> tuple[DataFrame, DataFrame]:
    """``terms(code, term, definition)`` and ``edges(child, parent)`` of a table with parents parted by ``|``; an unknown parent is an error."""
    p = F.split("value", "\t")
    rows = lines(spark, path).select(p[0].alias("code"), p[1].alias("term"), F.get(p, F.lit(2)).alias("parents"), F.get(p, F.lit(4)).alias("definition")).where("term is not null")
    edges = rows.select(F.col("code").alias("child"), F.explode(F.split("parents", r"\|")).alias("parent")).where(F.col("parent") != root).where("parent <> ''")
    unknown = edges.join(rows.select(F.col("code").alias("parent")), "parent", "left_anti").select("parent").first()
    if unknown:
        raise KeyError(f"unknown parent {unknown['parent']}")
    return rows.select("code", "term", "definition"), edges


def xml_entries(spark: SparkSession, path: str, tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


GENE_DISEASE = "HUGOGeneSymbol string, Sentence array<struct<GeneData:struct<MatchedGeneTerm:string>,DiseaseData:struct<MatchedDiseaseTerm:string,NCIDiseaseConceptCode:string>,Statement:string,EvidenceCode:array<string>,NegationIndicator:string,SentenceStatusFlag:string>>"


def gene_disease(spark: SparkSession, path: str) -> DataFrame:
    """``(gene, disease)`` of finished, not negated sentences of a gene-disease file."""
    s = xml_entries(spark, path, "GeneEntry", GENE_DISEASE).select(F.col("HUGOGeneSymbol").alias("gene"), F.explode("Sentence").alias("s"))
    s = s.where("lower(s.NegationIndicator) <> 'yes' and lower(s.SentenceStatusFlag) = 'finished'")
    return s.select("gene", F.col("s.DiseaseData.NCIDiseaseConceptCode").alias("disease")).where("disease is not null").distinct()


def gene_sentences(spark: SparkSession, entries: DataFrame, gene: str, status: str = "finished") -> DataFrame:
    """``(gene, disease, code, statement)``: the sentences of one gene, by a statement with named arguments over the entries.

    ``entries`` are rows of a gene-disease file as ``xml_entries`` gives them. Arguments are values, never text of the statement.
    """
    text = """
        SELECT HUGOGeneSymbol AS gene, s.DiseaseData.MatchedDiseaseTerm AS disease, s.DiseaseData.NCIDiseaseConceptCode AS code, s.Statement AS statement
        FROM {entries} LATERAL VIEW explode(Sentence) AS s
        WHERE HUGOGeneSymbol = :gene AND lower(s.SentenceStatusFlag) = lower(:status)"""
    return spark.sql(text, args={"gene": gene, "status": status}, entries=entries)


def path_report(spark: SparkSession, path: str) -> DataFrame:
    """``(pair, edges)`` of a report in which a line ``a->b:`` is followed by ``[e1, e2]`` or ``null``."""
    w = Window.partitionBy("file").orderBy("at")
    rows = _numbered(spark, path).withColumn("pair", F.lag("value").over(w))
    rows = rows.where(F.col("pair").rlike("->.*:$") & F.col("value").rlike(r"^(\[|null)"))
    inner = F.regexp_extract("value", r"^\[(.*)\]", 1)
    return rows.select(F.regexp_replace("pair", ":$", "").alias("pair"), F.when(inner != "", F.split(inner, ", ")).otherwise(F.array().cast("array<string>")).alias("edges"))


def dendrogram(spark: SparkSession, path: str) -> DataFrame:
    """``(at, distance, members, parent)`` of lines ``distance<tab>a,b,c``; a line's parent is the nearest later line that holds all its members."""
    p = F.split("value", "\t")
    rows = _numbered(spark, path).select("at", p[0].try_cast("double").alias("distance"), F.array_sort(F.split(p[1], ",")).alias("members"))
    up = rows.select(F.col("at").alias("up"), F.col("members").alias("whole"), F.explode("members").alias("m"))
    down = rows.select("at", F.size("members").alias("n"), F.explode("members").alias("m"))
    held = down.join(up, "m").where("up > at").groupBy("at", "n", "up").count().where("count = n").groupBy("at").agg(F.min("up").alias("parent"))
    return rows.join(held, "at", "left")


def map_nodes(spark: SparkSession, path: str, header: str = "SOM results:") -> DataFrame:
    """``(x, y, distance, labels, vector)`` of map files: after the header line, records of lines ``location:``, ``index:``, ``label:`` and ``vector:``.

    A record is what follows its location up to the next. Lines are put in the order of their file, and blocks are counted
    by running sums over range parts, so a record may lie across splits of a file.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block_start"), F.monotonically_increasing_id().alias("line"), "value")
    order = [F.col("block_start"), F.col("line")]
    is_header, is_first = F.startswith("value", F.lit(header)), F.startswith("value", F.lit("location:"))
    counted = running_sums(cut(rows), ["file"], order, headers=is_header.cast("long"), record=is_first.cast("long"))
    inside = counted.where("headers > 0 and record > 0")
    part = lambda name: F.max(F.when(F.startswith("value", F.lit(name)), F.substring_index("value", name, -1)))
    found = inside.groupBy("file", "record").agg(part("location:").alias("location"), part("index:").alias("distance"), part("label:").alias("labels"), part("vector:").alias("vector")).where("location is not null")
    place = F.split("location", r",\s*")
    numbers = F.transform(F.filter(F.split("vector", ","), lambda v: F.trim(v) != ""), lambda v: v.cast("double"))
    labels = F.when(F.col("labels").isNull(), F.array().cast("array<string>")).otherwise(F.split("labels", ", "))
    return found.select(place[0].cast("int").alias("x"), place[1].cast("int").alias("y"), F.col("distance").cast("double").alias("distance"), labels.alias("labels"), numbers.alias("vector"))


def base64_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoded)``: whole files in URL-safe base 64."""
    return spark.read.format("binaryFile").load(path).select("path", F.translate(F.base64("content"), "+/", "-_").alias("encoded"))


def from_base64(encoded: Column) -> Column:
    return F.unbase64(F.translate(encoded, "-_", "+/"))


def chromosome_of(file: Column) -> Column:
    """Chromosome from a file name: what follows ``chr``, without leading zeros."""
    return F.regexp_replace(F.regexp_extract(file, r"chr0*([0-9A-Za-z]+)", 1), "^0+", "")


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"
