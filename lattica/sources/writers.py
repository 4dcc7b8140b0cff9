"""Writers of the same layouts. Each writes a folder of part files; ordered outputs are range-partitioned, so parts are in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.network import vertices
from lattica.session import cut


def write_lines(df: DataFrame, column: str, path: str, sort: bool = False) -> None:
    rows = df.select(F.col(column).cast("string").alias("value"))
    (rows.orderBy("value") if sort else rows).write.mode("overwrite").text(path)


def write_map(df: DataFrame, key: str, value: str, path: str, sort: bool = False, sep: str = "\t") -> None:
    """Lines ``key<tab>value``; array values are written one line each."""
    v = F.explode(value) if dict(df.dtypes)[value].startswith("array") else F.col(value)
    rows = df.select(F.col(key).alias("k"), v.alias("v"))
    rows = rows.orderBy("k", "v") if sort else rows
    rows.select(F.concat_ws(sep, F.col("k").cast("string"), F.col("v").cast("string"))).write.mode("overwrite").text(path)


def write_matrix(m: DataFrame, path: str, samples: list | None = None) -> None:
    """A wide table with a header; missing cells are empty."""
    wide = m.groupBy("feature").pivot("sample", samples).agg(F.first("value"))
    wide.orderBy("feature").write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "").csv(path)


def write_attributes(df: DataFrame, key: str, value: str, name: str, kind: str, path: str) -> None:
    """A node attribute file: a header line and lines ``key=value``."""
    head = df.sparkSession.createDataFrame([(f"{name} (class={kind})",)], "value string").withColumn("o", F.lit(0))
    body = df.select(F.concat_ws("=", F.col(key).cast("string"), F.col(value).cast("string")).alias("value"), F.lit(1).alias("o"))
    head.union(body).orderBy("o", "value").select("value").write.mode("overwrite").text(path)


def node_index(edges: DataFrame) -> DataFrame:
    """``(index, node)``: nodes numbered from 1 in order, by counts of ranges and numbers inside them."""
    nodes = cut(vertices(edges).repartitionByRange("node").withColumn("part", F.spark_partition_id()))
    nodes = nodes.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("node")))
    sizes = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return nodes.join(F.broadcast(base), "part").select((F.col("base") + F.col("r")).alias("index"), "node")


def write_indexed_network(edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    """A node list ``index node`` and an edge list ``index index 1``."""
    index = cut(node_index(edges))
    index.orderBy("index").select(F.concat_ws(" ", F.col("index").cast("string"), F.col("node").cast("string"))).write.mode("overwrite").text(nodes_path)
    e = edges.join(index.select(F.col("node").alias("src"), F.col("index").alias("i")), "src").join(index.select(F.col("node").alias("dst"), F.col("index").alias("j")), "dst")
    e.orderBy("i", "j").select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.lit("1"))).write.mode("overwrite").text(edges_path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """One line a cluster, members parted by tabs, largest first."""
    lines = clusters.groupBy("cluster").agg(F.array_sort(F.collect_set(F.col("node").cast("string"))).alias("m"))
    lines.orderBy(F.desc(F.size("m")), "cluster").select(F.array_join("m", "\t")).write.mode("overwrite").text(path)


def write_sif_by_cluster(inner: DataFrame, path: str, relation: str = "FI") -> None:
    """One folder of interaction lines for each cluster of ``(cluster, src, dst)``."""
    line = F.concat_ws("\t", F.col("src").cast("string"), F.lit(relation), F.col("dst").cast("string"))
    inner.select("cluster", line.alias("value")).write.mode("overwrite").partitionBy("cluster").text(path)


def write_map_nodes(nodes: DataFrame, path: str, header: str = "SOM results:") -> None:
    """One file of a map's ``(x, y, distance, labels, vector)``, a node of a grid of fixed size each: a header, then a record of lines a node."""
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("label:"), F.array_join("labels", ", ")))
    vector = F.concat(F.lit("vector:"), F.array_join(F.transform("vector", lambda v: F.concat(v.cast("string"), F.lit(","))), ""))
    record = F.concat_ws("\n", F.concat(F.lit("location:"), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string")), F.concat(F.lit("index:"), F.col("distance").cast("string")), labels, vector)
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(header).alias("value"))
    rows = head.union(nodes.select(F.lit(1).alias("o"), "x", "y", record.alias("value")))
    rows.coalesce(1).sortWithinPartitions("o", "x", "y").select("value").write.mode("overwrite").text(path)


def write_components(modules: DataFrame, path: str, least: int = 4) -> None:
    """One folder of members, ``component=name``, for each component of at least ``least`` members."""
    large = modules.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("component")
    modules.join(large, "component").select("component", F.col("node").cast("string").alias("value")).write.mode("overwrite").partitionBy("component").text(path)


def write_gene_scores(table: DataFrame, path: str) -> None:
    """Lines of the first and the last column."""
    first, last = table.columns[0], table.columns[-1]
    table.select(F.concat_ws(" ", F.col(f"`{first}`").cast("string"), F.col(f"`{last}`").cast("string"))).write.mode("overwrite").text(path)


def write_dense(cells: DataFrame, path: str) -> None:
    """Rows of ``(i, j, value)`` as tab-parted lines in order."""
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("c"))
    rows.orderBy("i").select(F.array_join(F.transform("c", lambda x: x["value"].cast("string")), "\t")).write.mode("overwrite").text(path)


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins between the least and largest value; the data of a chart."""
    keys = by or []
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    both = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * bins), F.lit(bins - 1))
    return both.groupBy(*keys, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Five-number summaries by group; the data of a box chart."""
    return df.groupBy(*by).agg(F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"))


def enrichment_line(term: Column, ratio: Column, n: Column, hits: Column, p: Column, fdr: Column, keys: Column) -> Column:
    """One result as text: fields parted by tabs, keys by commas."""
    return F.concat_ws("\t", term.cast("string"), F.format_string("%.4f", ratio), n.cast("string"), hits.cast("string"), F.format_string("%.4e", p), F.format_string("%.4e", fdr), F.array_join(keys, ","))


def file_name(text: Column) -> Column:
    """Signs that file names should not hold become underscores."""
    return F.regexp_replace(text, r"[ ()/&+]", "_")


def without_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")
