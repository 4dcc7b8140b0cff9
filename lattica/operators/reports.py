"""Reports that bring clusters, topics, paths and reactions together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.special import binomial_tail
from lattica.functions.special import hypergeometric_tail
from lattica.operators.enrichment import cluster_terms, enrich
from lattica.operators.ranking import numbered

# Letters of pathway data sources; any other source is R.
SOURCE_LETTERS = {"KEGG": "K", "Pathway Interaction Database": "N", "BioCarta": "B", "Cell Map": "C", "Panther": "P", "INOH": "I"}


def source_letter(source: Column) -> Column:
    out = F.lit("R")
    for name, letter in SOURCE_LETTERS.items():
        out = F.when(source.contains(name), letter).otherwise(out)
    return out


def edge_of_name(name: Column) -> Column:
    """``(a : b)`` as ``a<tab>b``."""
    return F.regexp_replace(F.regexp_replace(name, r"^\(|\)$", ""), " : ", "\t")


def fdr_text(fdr: Column, random_total: Column, real_total: Column) -> Column:
    """A rate with as many digits as the real values support; a zero says that it is under the next step."""
    digits = F.greatest(F.floor(F.log10(real_total.cast("double"))), F.lit(0)).cast("int")
    step = F.format_string("%.0e", 1.0 / random_total)
    text = F.lit(None).cast("string")
    for n in range(9, -1, -1):
        text = F.when(digits == n, F.format_string(f"%.{n}e", fdr)).otherwise(text)
    return F.when(fdr == 0, F.concat(F.lit("<"), step)).otherwise(text)


def positions(lists: DataFrame, group: str, items: str) -> DataFrame:
    """``(group, item, index)`` of the items of ordered lists, from 0."""
    return lists.select(F.col(group).alias("group"), F.posexplode(items).alias("index", "item")).select("group", "item", "index")


def adjacent(edges: DataFrame, placed: DataFrame, gap: int = 1) -> DataFrame:
    """Edges whose ends lie in one group of ``placed(group, item, index)`` no more than ``gap`` apart."""
    a = placed.select(F.col("item").alias("src"), F.col("group").alias("ga"), F.col("index").alias("ia"))
    b = placed.select(F.col("item").alias("dst"), F.col("group").alias("gb"), F.col("index").alias("ib"))
    met = edges.join(a, "src").join(b, "dst").where((F.col("ga") == F.col("gb")) & (F.abs(F.col("ia") - F.col("ib")) <= gap))
    return met.select("src", "dst").distinct()


def enrich_by_type(query: DataFrame, annotation: DataFrame, kind: str, mode: str = "standard") -> DataFrame:
    """Enrichment against the annotation ``(key, term, type)`` of one type."""
    return enrich(query, annotation.where(F.col("type") == kind).select("key", "term"), mode)


def topic_tails(overlaps: DataFrame, cluster_sizes: DataFrame, topic_sizes: DataFrame, total: int, least_size: int = 9) -> DataFrame:
    """``(cluster, term, hits, p_value)``: hypergeometric tails from counts, of clusters of at least ``least_size``.

    ``overlaps(cluster, term, hits)`` are members that a cluster and a term share, ``cluster_sizes(cluster, n)`` and
    ``topic_sizes(term, n)`` the members of each, out of ``total``. A term without a size is an error when it is read.
    """
    sizes = cluster_sizes.where(F.col("n") >= least_size).select("cluster", F.col("n").alias("size"))
    met = overlaps.join(sizes, "cluster").join(topic_sizes.select("term", F.col("n").alias("in_term")), "term", "left")
    known = F.coalesce("in_term", F.raise_error(F.concat(F.lit("term without a size: "), F.col("term"))).cast("long"))
    return met.select("cluster", "term", "hits", hypergeometric_tail(F.lit(total), known, F.col("size"), F.col("hits")).alias("p_value"))


def topics_of_members(clusters: DataFrame, topics: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, cluster, size, topics)`` of ``members(node)``: the smallest cluster name that holds each, and its topics, none if it has none."""
    first = clusters.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("cluster").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.countDistinct("node").alias("size"))
    of = topics.groupBy("cluster").agg(F.array_sort(F.collect_set("term")).alias("topics"))
    found = first.join(sizes, "cluster").join(of, "cluster", "left")
    return found.select("node", "cluster", "size", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def significant_topics(clusters: DataFrame, annotation: DataFrame, p: float = 1e-4, share: float = 0.1, least_size: int = 9) -> DataFrame:
    """Terms of clusters of at least ``least_size`` with a tail under ``p`` that more than ``share`` of the cluster has."""
    found = cluster_terms(clusters, annotation, least_size, p)
    return found.where((F.col("p_value") < p) & (F.col("hits") > share * F.col("size")))


def cluster_report(clusters: DataFrame, topics: DataFrame, best: int = 3) -> DataFrame:
    """``(cluster, members, topic1, topic2, ...)``: every cluster with its ``best`` topics of ``(cluster, term, p_value)``, smallest tails first."""
    ranked = topics.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct("p_value", "term"))), 1, best).alias("t"))
    sizes = clusters.groupBy("cluster").agg(F.countDistinct("node").alias("members"))
    columns = [F.get("t", F.lit(i))["term"].alias(f"topic{i + 1}") for i in range(best)]
    return sizes.join(ranked, "cluster", "left").select("cluster", "members", *columns)


def best_topic(clusters: DataFrame, cliqueness: DataFrame, topics: DataFrame) -> DataFrame:
    """``(cluster, members, cliqueness, term)``: the topic of smallest tail of each cluster, if it has any."""
    first = topics.groupBy("cluster").agg(F.min_by("term", F.struct("p_value", "term")).alias("term"))
    sizes = clusters.groupBy("cluster").agg(F.countDistinct("node").alias("members"))
    return sizes.join(cliqueness.select("cluster", "cliqueness"), "cluster", "left").join(first, "cluster", "left")


def labelled_clusters(clusters: DataFrame, centrality: DataFrame) -> DataFrame:
    """``(cluster, label, value)``: each cluster's nodes of highest centrality ``(node, value)``, ties joined by commas."""
    both = clusters.join(centrality, "node")
    top = both.groupBy("cluster").agg(F.max("value").alias("value"))
    tied = both.join(top, ["cluster", "value"]).groupBy("cluster", "value").agg(F.array_sort(F.collect_set(F.col("node"))).alias("n"))
    return tied.select("cluster", F.array_join("n", ",").alias("label"), "value")


def path_lengths(paths: DataFrame, group: str) -> DataFrame:
    """``(group, n, mean_length)`` of paths ``(group, path)`` in edges."""
    return paths.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("path") - 1).alias("mean_length"))


def topics_on_paths(path_edges: DataFrame, edge_topics: DataFrame) -> DataFrame:
    """``(topic, paths)``: on how many paths ``(source, node)`` a topic's edges lie."""
    on = path_edges.join(edge_topics, ["src", "dst"]).select("source", "node", "topic").distinct()
    return on.groupBy("topic").agg(F.count(F.lit(1)).alias("paths"))


def path_p_value(ratio: Column, length: Column, both: Column) -> Column:
    """Chance that at least ``both`` of ``length`` edges have a property that the share ``ratio`` of all edges has."""
    return binomial_tail(ratio, length, both)


def edges_in(path_edges: DataFrame, curated: DataFrame) -> DataFrame:
    """``(source, node, curated)``: how many edges of each path are in the list."""
    marked = path_edges.join(curated.select("src", "dst", F.lit(1).alias("c")), ["src", "dst"], "left")
    return marked.groupBy("source", "node").agg(F.count("c").alias("curated"))


def partners_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, partners)`` over neighbours that are in the set."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("p")), F.struct(F.col("dst").alias("node"), F.col("src").alias("p")))).alias("e")).select("e.*")
    return both.join(nodes.select(F.col("node").alias("p")).distinct(), "p", "left_semi").groupBy("node").agg(F.count_distinct("p").alias("partners"))


def ranked_paths(paths: DataFrame, members: DataFrame, degree: DataFrame, curated: DataFrame) -> DataFrame:
    """``(source, node, length, linkers, curated, degrees, place)``: candidate paths, the one to take first first.

    Shorter paths lead, then those of fewer nodes outside ``members``, of more curated edges, of lower degrees together.
    """
    own = paths.select("source", "node", "path")
    on = own.select("source", "node", F.explode("path").alias("n"))
    marked = on.join(members.select(F.col("node").alias("n"), F.lit(1).alias("m")).distinct(), "n", "left").join(degree.select(F.col("node").alias("n"), "degree"), "n", "left")
    sums = marked.groupBy("source", "node").agg((F.count(F.lit(1)) - F.count("m")).alias("linkers"), F.sum("degree").alias("degrees"))
    steps = own.select("source", "node", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("e"))
    steps = steps.select("source", "node", F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst"))
    out = own.join(sums, ["source", "node"]).join(edges_in(steps, curated), ["source", "node"], "left").na.fill(0, ["curated"])
    out = out.select("source", "node", (F.size("path") - 1).alias("length"), "linkers", "curated", "degrees")
    order = [F.col("length"), F.col("linkers"), F.desc("curated"), F.col("degrees"), F.col("source"), F.col("node")]
    return numbered(out, [], order, "place")


def reaction_graph(inputs: DataFrame, outputs: DataFrame, chemicals: DataFrame) -> DataFrame:
    """``(src, dst)``: a reaction comes before another that takes in what it gives out; items in ``chemicals(item)`` do not count. Self-loops stay."""
    gives = outputs.join(chemicals, "item", "left_anti").select(F.col("reaction").alias("src"), "item")
    takes = inputs.join(chemicals, "item", "left_anti").select(F.col("reaction").alias("dst"), "item")
    return gives.join(takes, "item").select("src", "dst").distinct()


def open_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items that the reactions take in and none of them gives out."""
    return inputs.select("item").distinct().join(outputs.select("item"), "item", "left_anti")


def mean_overlap(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, node, similarity)``: mean overlap of an item's set with the sets held by a node, over the smaller of both.

    ``sets(id, element)`` holds the elements, ``nodes(node, id)`` which sets a node holds.
    """
    sizes = sets.groupBy("id").agg(F.count_distinct("element").alias("n"))
    held = nodes.join(sets.select("id", "element").distinct(), "id").select("node", F.col("id").alias("other"), "element")
    shared = sets.select("id", "element").distinct().join(held, "element").groupBy("id", "node", "other").agg(F.count(F.lit(1)).alias("k"))
    each = shared.join(sizes, "id").join(sizes.select(F.col("id").alias("other"), F.col("n").alias("m")), "other")
    total = each.groupBy("id", "node").agg(F.sum(F.col("k") / F.least("n", "m")).alias("s"))
    count = nodes.groupBy("node").agg(F.count_distinct("id").alias("c"))
    return total.join(count, "node").select("id", "node", (F.col("s") / F.col("c")).alias("similarity"))


def mean_distance_within(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, distance)``: mean of ``pairs(src, dst, distance)`` between the items a node holds; 0 for a single one."""
    a, b = (nodes.select(F.col("id").alias(x), F.col("node").alias(f"n_{x}")) for x in ("src", "dst"))
    inner = pairs.join(a, "src").join(b, "dst").where("n_src = n_dst").groupBy(F.col("n_src").alias("node")).agg(F.avg("distance").alias("distance"))
    return nodes.select("node").distinct().join(inner, "node", "left").select("node", F.coalesce("distance", F.lit(0.0)).alias("distance"))


def boundary_probability(swept: DataFrame, at: int) -> float:
    """The Lovász-Simonovits curve of ``swept(position, volume, rank)`` at volume ``at``, linear between positions; past the last it stays."""
    ordered = swept.select("volume", "cumulated")
    below = ordered.where(F.col("volume") <= at).agg(F.max_by(F.struct("volume", "cumulated"), "volume").alias("x")).first()["x"]
    above = ordered.where(F.col("volume") > at).agg(F.min_by(F.struct("volume", "cumulated"), "volume").alias("x")).first()["x"]
    low = (below["volume"], below["cumulated"]) if below else (0, 0.0)
    if above is None:
        return float(low[1])
    return float(low[1] + (above["cumulated"] - low[1]) * (at - low[0]) / (above["volume"] - low[0]))


def common_samples(values: DataFrame, times: DataFrame, events: DataFrame) -> DataFrame:
    """``(sample, value, time, event)`` of samples that all three maps have: what a survival model takes."""
    return values.join(times, "sample").join(events, "sample").select("sample", "value", "time", "event")
