"""Undirected networks as edge lists ``(src, dst)`` with ``src < dst``: set algebra, degrees, hubs and local measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.ranking import numbered


def canonical(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct edges, smaller end first, without self-interactions or null ends."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def co_occurrence(members: DataFrame, group: str, item: str) -> DataFrame:
    """Edges between items of one group."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    left, right = m.alias("l"), m.alias("r")
    pairs = left.join(right, (F.col("l.g") == F.col("r.g")) & (F.col("l.i") < F.col("r.i")))
    return pairs.select(F.col("l.i").alias("src"), F.col("r.i").alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions as ``(node, neighbour)``, from one scan."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour"))))
    return edges.select(both.alias("e")).select("e.node", "e.neighbour")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """``(node, neighbours)`` with sorted neighbour sets."""
    return symmetric(edges).groupBy("node").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``; edges are distinct, so a count is a count of partners."""
    return symmetric(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """One row: edges, nodes, mean and largest degree, and the smallest node that has it."""
    d = degrees(edges).agg(
        (F.sum("degree") / 2).cast("long").alias("edges"), F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"),
        F.max_by("node", F.struct("degree", -F.col("node"))).alias("top_node"),
    )
    return d


def hubs(edges: DataFrame, share: float = 0.05) -> DataFrame:
    """``(node, degree, is_hub)``: the floor(n * share) nodes of highest degree are hubs, ties by node.

    The cut is found on the degree histogram, and only nodes at the cut degree are numbered, by range parts.
    """
    d = degrees(edges)
    hist = d.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    cum = hist.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
    want = hist.agg(F.floor(F.sum("n") * share).alias("k"))
    cut = cum.crossJoin(F.broadcast(want)).select(F.col("degree").alias("deg"), "n", (F.col("k") - F.col("before")).alias("room"))
    placed = d.join(F.broadcast(cut), F.col("degree") == F.col("deg"))
    clear = placed.where("room <= 0 or room >= n").select("node", "degree", (F.col("room") > 0).alias("is_hub"))
    tied = numbered(placed.where("room > 0 and room < n"), [], [F.col("node")])  # nodes of the one degree at which the cut falls
    return clear.union(tied.select("node", "degree", (F.col("rank") <= F.col("room")).alias("is_hub")))


def without_hubs(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """The network that remains when the top hubs and their edges go."""
    gone = hubs(edges, share).where("is_hub").select("node")
    return edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end in ``nodes(node)``."""
    left = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    right = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return left.select("src", "dst").union(right.select("src", "dst")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node)``."""
    left = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return left.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def edge_key(a: Column, b: Column, sep: str = "\t") -> Column:
    """Name of an undirected edge, smaller end first."""
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c)`` with a < b < c.

    Edges are directed from the end of lower degree, so that no hub expands all its pairs; each wedge is checked
    against the edge list by an equi-join. Edges and degrees are not broadcast: written compactly they look small, but are not on the driver.
    """
    d = degrees(edges).hint("merge")
    e = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src"))
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("high"))
    wedge = o.alias("x").join(o.alias("y").hint("merge"), (F.col("x.low") == F.col("y.low")) & (F.col("x.high") < F.col("y.high")))
    wedge = wedge.select(F.col("x.low").alias("w"), F.col("x.high").alias("src"), F.col("y.high").alias("dst"))
    t = F.array_sort(F.array("w", "src", "dst"))
    return wedge.join(edges.hint("merge"), ["src", "dst"]).select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """``(node, degree, cliqueness)``: share of a node's neighbour pairs that are linked; 1 for a single neighbour."""
    count = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    d = degrees(edges).join(count.hint("merge"), "node", "left")
    value = F.when(F.col("degree") == 1, 1.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1)))
    return d.select("node", "degree", value.alias("cliqueness"))


def shared_neighbour_distance(edges: DataFrame) -> DataFrame:
    """Topological-overlap distance of every edge: 1 - (shared neighbours + 1) / smaller degree."""
    d = degrees(edges)
    t = triangles(edges)
    sides = t.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")), F.struct(F.col("b").alias("src"), F.col("c").alias("dst")))).alias("e"))
    shared = sides.groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("shared"))
    e = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    e = e.join(shared, ["src", "dst"], "left")
    return e.select("src", "dst", (1.0 - (F.coalesce("shared", F.lit(0)) + 1) / F.least("ds", "dd")).alias("distance"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster, size, inside, degree_sum, modularity)`` for each cluster of ``clusters(node, cluster)``; the sum is the partition's."""
    c = clusters.select("node", "cluster").distinct()
    e = edges.join(c.select(F.col("node").alias("src"), F.col("cluster").alias("cs")), "src", "left").join(c.select(F.col("node").alias("dst"), F.col("cluster").alias("cd")), "dst", "left")
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("cluster"), (F.col("cs") == F.col("cd")).alias("inner")), F.struct(F.col("cd").alias("cluster"), (F.col("cs") == F.col("cd")).alias("inner")))).alias("x")).select("x.*")
    per = ends.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("degree_sum"), (F.count(F.when(F.col("inner"), 1)) / 2).cast("long").alias("inside"))
    total = edges.agg(F.count(F.lit(1)).alias("m"))
    sizes = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    out = sizes.join(per, "cluster", "left").crossJoin(F.broadcast(total)).na.fill(0, ["degree_sum", "inside"])
    return out.select("cluster", "size", "inside", "degree_sum", (F.col("inside") / F.col("m") - F.pow(F.col("degree_sum") / (2 * F.col("m")), 2)).alias("modularity"))


def within_clusters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster, src, dst)`` for edges whose ends share a cluster."""
    c = clusters.select("node", "cluster").distinct()
    e = edges.join(c.select(F.col("node").alias("src"), "cluster"), "src")
    return e.join(c.select(F.col("node").alias("dst"), F.col("cluster")), ["dst", "cluster"]).select("cluster", "src", "dst")


def cluster_cliqueness(edges: DataFrame, clusters: DataFrame, least: int = 6) -> DataFrame:
    """Mean clustering coefficient of the members of each cluster of at least ``least`` members, in its own edges."""
    inner = within_clusters(edges, clusters)
    keyed = inner.select(F.struct("cluster", F.col("src").alias("id")).alias("src"), F.struct("cluster", F.col("dst").alias("id")).alias("dst"))
    local = clustering_coefficient(keyed).groupBy("node.cluster").agg(F.avg("cliqueness").alias("cliqueness"), F.count(F.lit(1)).alias("linked"))
    sizes = clusters.select("node", "cluster").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return sizes.join(local, "cluster").select("cluster", "size", "linked", "cliqueness")


def conductance(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Boundary over the smaller of a cluster's volume and the rest's."""
    m = modularity(edges, clusters).select("cluster", "inside", "degree_sum")
    total = edges.agg((2 * F.count(F.lit(1))).alias("vol"))
    boundary = F.col("degree_sum") - 2 * F.col("inside")
    return m.crossJoin(F.broadcast(total)).select("cluster", boundary.alias("boundary"), F.col("degree_sum").alias("volume"), (boundary / F.least(F.col("degree_sum"), F.col("vol") - F.col("degree_sum"))).alias("conductance"))
