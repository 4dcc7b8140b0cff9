"""Hierarchical clustering over pair distances, spanning forests, self-organising maps and term weights."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import connected_components
from lattica.operators.ranking import numbered, running_sums
from lattica.session import cut, remove, settled


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """Edges ``(src, dst, distance)`` of a minimum spanning forest by Boruvka rounds; equal distances go by the pair's ids.

    Sorted by distance these are the merges of single-linkage clustering. A round picks the least edge of every tree; the
    picks of a tree lead, from tree to tree, to two that picked the same edge, and the smaller of those names the new tree. Only the
    least edge between two trees goes on, so rounds work on fewer trees and edges each.
    """
    e = pairs.where("src <> dst").select("src", "dst", F.col("distance").cast("double").alias("distance"))
    work = settled(e.select(F.struct("distance", "src", "dst").alias("e"), F.col("src").alias("cs"), F.col("dst").alias("cd")))
    chosen = []
    while True:  # a round at least halves the number of trees
        ends = work.select("e", F.explode(F.array(F.struct(F.col("cs").alias("c"), F.col("cd").alias("other")), F.struct(F.col("cd").alias("c"), F.col("cs").alias("other")))).alias("x"))
        picked = settled(ends.groupBy("x.c").agg(F.min(F.struct("e", "x.other")).alias("p")).select("c", "p.other", "p.e"))
        if picked.isEmpty():
            remove(work)
            remove(picked)
            break
        chosen.append(settled(picked.select("e.src", "e.dst", "e.distance").distinct()))
        back = picked.select(F.col("c").alias("other"), F.col("other").alias("c"), F.lit(True).alias("mutual"))
        root = F.col("mutual").isNotNull() & (F.col("c") < F.col("other"))
        label = settled(picked.join(back, ["c", "other"], "left").select(F.col("c").alias("name"), F.when(root, F.col("c")).otherwise(F.col("other")).alias("at")), picked)
        label = _doubled(label, [])
        at = lambda c: label.select(F.col("name").alias(c), F.col("at").alias(f"{c}_at"))
        kept = work.join(at("cs"), "cs").join(at("cd"), "cd").where("cs_at <> cd_at")
        kept = kept.groupBy(F.least("cs_at", "cd_at").alias("cs"), F.greatest("cs_at", "cd_at").alias("cd")).agg(F.min("e").alias("e"))
        work = settled(kept.select("e", "cs", "cd"), work, label)
    return reduce(DataFrame.union, chosen) if chosen else e.limit(0)


def agglomerate(pairs: DataFrame, linkage: str = "average") -> DataFrame:
    """``(merged, left, right, distance, size)``: the merges of hierarchical clustering over a full list of pair distances.

    Clusters that are each other's nearest merge at once, which for single, complete and average linkage gives the same
    tree as merging one pair at a time; a cluster is named by its smallest member, ties go to the smaller names. The list of
    pairs grows with the square of the members: that is what the method works on.
    """
    if linkage not in ("single", "complete", "average"):
        raise ValueError(linkage)
    d = cut(pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("distance").cast("double").alias("d")))
    sizes = cut(d.select(F.explode(F.array("a", "b")).alias("c")).distinct().withColumn("n", F.lit(1).cast("long")))
    out = None
    for step in itertools.count():  # the least pair always merges, so every round has one
        both = d.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.struct("d", F.col("a").alias("x"), F.col("b").alias("y")).alias("e")), F.struct(F.col("b").alias("c"), F.struct("d", F.col("a").alias("x"), F.col("b").alias("y")).alias("e")))).alias("z")).select("z.*")
        near = both.groupBy("c").agg(F.min("e").alias("e"))
        merge = cut(near.groupBy("e").count().where("count = 2").select("e.x", "e.y", "e.d"))
        if merge.isEmpty():
            break
        names = sizes.join(merge.select(F.col("y").alias("c"), F.col("x").alias("into")), "c", "left").select("c", "n", F.coalesce("into", "c").alias("into"))
        names = cut(names)
        grown = names.groupBy("into").agg(F.sum("n").alias("size"))
        rows = merge.join(grown, merge["x"] == grown["into"]).select(F.col("x").alias("merged"), F.col("x").alias("left"), F.col("y").alias("right"), F.col("d").alias("distance"), "size", F.lit(step).alias("round"))
        out = rows if out is None else out.union(rows)
        na = names.select(F.col("c").alias("a"), F.col("n").alias("wa"), F.col("into").alias("ia"))
        nb = names.select(F.col("c").alias("b"), F.col("n").alias("wb"), F.col("into").alias("ib"))
        moved = d.join(na, "a").join(nb, "b").where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "d", (F.col("wa") * F.col("wb")).alias("w"))
        value = {"single": F.min("d"), "complete": F.max("d"), "average": F.sum(F.col("d") * F.col("w")) / F.sum("w")}[linkage]
        d = cut(moved.groupBy("a", "b").agg(value.alias("d")))
        sizes = cut(grown.select(F.col("into").alias("c"), F.col("size").alias("n")))
    return out if out is not None else d.select(F.col("a").alias("merged"), F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("distance"), F.lit(2).cast("long").alias("size"), F.lit(0).alias("round")).limit(0)


def cut_tree(merges: DataFrame, height: float) -> DataFrame:
    """``(node, cluster)``: clusters that the merges up to ``height`` make; members that no merge reaches are left out."""
    low = merges.where(F.col("distance") <= height).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    return connected_components(low).withColumnRenamed("component", "cluster")


def tree_order(merges: DataFrame) -> DataFrame:
    """``(node, merge, root, leaf, size, depth, depth_first, breadth_first)``: every node of the trees that ``merges`` make.

    ``merges(merged, left, right, round)`` names a merge by its left part; ``merge`` counts the merges of a name, 0 for the
    leaf. ``depth_first`` numbers a tree's nodes from 1, a node before its left part before its right; ``breadth_first`` level
    by level in the same order; ``size`` counts leaves. The merges of a name are one way down to its leaf, so places on it
    are running sums; only the names' last merges, a row a name, are walked up, by doubling: each round joins every name with
    the one twice as far up, so names of any depth take rounds by its logarithm.
    """
    own = settled(merges.select(F.col("merged").alias("name"), "right", "round"))
    names = settled(own.select("name").union(own.select("right")).distinct())
    leaves = _leaf_counts(names, own.select(F.col("right").alias("name"), F.col("name").alias("at")))
    placed = settled(own.join(leaves.select(F.col("name").alias("right"), "size"), "right"))
    placed = settled(running_sums(placed, ["name"], [F.col("round")], k=F.lit(1).cast("long"), more="size").drop("round"), placed)
    top = settled(placed.groupBy("name").agg(F.max("k").alias("top")))
    # A right part comes after all nodes of its left sister: as many as twice its leaves less one.
    above = F.col("top") - F.col("k")
    step = placed.join(top, "name").select(F.col("right").alias("name"), F.col("name").alias("at"), (above + 1).alias("depth"), (above + 2 * (1 + F.col("more") - F.col("size"))).alias("place"))
    none = F.lit(0).cast("long")
    roots = names.join(own.select(F.col("right").alias("name")), "name", "left_anti").select("name", F.col("name").alias("at"), none.alias("depth"), none.alias("place"))
    up = _doubled(settled(step.union(roots)), ["depth", "place"])
    nodes = placed.select("name", "k", (F.col("more") + 1).alias("size")).union(names.select("name", none, F.lit(1).cast("long")))
    ways = up.join(top, "name", "left").select("name", F.col("at").alias("root"), "depth", "place", F.coalesce("top", none).alias("top"))
    known = nodes.join(ways, "name").select("name", "k", "root", "size", (F.col("depth") + above).alias("depth"), (F.col("place") + above).alias("place"))
    known = numbered(settled(known), ["root"], [F.col("depth"), F.col("place")], "breadth_first")
    return known.select(F.col("name").alias("node"), F.col("k").alias("merge"), "root", (F.col("k") == 0).alias("leaf"), "size", "depth", (F.col("place") + 1).alias("depth_first"), "breadth_first")


def _doubled(up: DataFrame, sums: list[str]) -> DataFrame:
    """``(name, at, sums)`` with ``at`` moved on to the root and the sums of the whole way."""
    while True:
        ahead = up.select(F.col("name").alias("at"), F.col("at").alias("far"), *[F.col(c).alias(f"{c}_ahead") for c in sums])
        new = up.select("name", "at", *sums).join(ahead, "at").select("name", F.col("far").alias("at"), *[(F.col(c) + F.col(f"{c}_ahead")).alias(c) for c in sums], (F.col("at") != F.col("far")).alias("moved"))
        up = settled(new, up)
        if up.where("moved").isEmpty():
            return up.drop("moved")


def _leaf_counts(names: DataFrame, below: DataFrame) -> DataFrame:
    """``(name, size)``: how many names ``below(name, at)`` puts under every name, itself counted, again by doubling.

    After i rounds a name has counted those fewer than 2^i steps below it; the others are under its descendants 2^i
    steps below, each by one of them.
    """
    value = settled(names.select("name", F.lit(1).cast("long").alias("size")))
    jump = settled(below)
    while not jump.isEmpty():
        sent = value.join(jump, "name").groupBy(F.col("at").alias("name")).agg(F.sum("size").alias("more"))
        value = settled(value.join(sent, "name", "left").select("name", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), value)
        on = jump.select(F.col("name").alias("at"), F.col("at").alias("far"))
        jump = settled(jump.join(on, "at").select("name", F.col("far").alias("at")), jump)
    return value


def tf_idf(tokens: DataFrame) -> DataFrame:
    """``(doc, term, weight)`` from ``(doc, term, n)``: share of the document's tokens times log10 of documents over those with the term.

    Tokens that come parted by document stay where they are until they meet the counts of their terms, by the only join;
    others are dealt out by document first.
    """
    counts = tokens.where("doc is not null").groupBy("doc", "term").agg(F.sum("n").alias("n"))
    counts = settled(counts.withColumn("total", F.sum("n").over(Window.partitionBy("doc"))))
    per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    docs = counts.select("doc").distinct().agg(F.count(F.lit(1)).alias("docs"))
    t = counts.join(per_term.repartition(F.xxhash64("term")), "term").crossJoin(F.broadcast(docs))
    return t.select("doc", "term", (F.col("n") / F.col("total") * F.log10(F.col("docs") / F.col("df"))).alias("weight"))


class SelfOrganisingMap:
    """A square grid of reference vectors, trained in batches.

    The grid is a model of fixed size. Each step the rows find their node in parallel and give sums by node; a node
    becomes the mean of all rows assigned within a square that shrinks from ``width`` to 0.
    """

    def __init__(self, side: int = 24, steps: int = 20, width: int = 8):
        self.side, self.steps, self.width = side, steps, width
        self.nodes = np.zeros((side * side, 0))

    def fit(self, vectors: DataFrame) -> SelfOrganisingMap:
        """``vectors(id, vector)``; the grid starts from the rows of smallest id, repeated as often as needed."""
        first = vectors.orderBy("id").limit(self.side * self.side).toPandas()
        if first.empty:
            return self
        start = np.stack(first["vector"].map(np.asarray)).astype(float)
        self.nodes = start[np.arange(self.side * self.side) % len(start)]
        for step in range(self.steps):
            width = int(self.width * (1 - step / self.steps))
            sums = self._sums(vectors)
            count = np.zeros((self.side, self.side))
            total = np.zeros((self.side, self.side, self.nodes.shape[1]))
            for r in sums.itertuples():
                count[r.node // self.side, r.node % self.side] = r.n
                total[r.node // self.side, r.node % self.side] = r.total
            for x in range(self.side):
                for y in range(self.side):
                    box = (slice(max(0, x - width), x + width + 1), slice(max(0, y - width), y + width + 1))
                    if n := count[box].sum():
                        self.nodes[x * self.side + y] = total[box].sum(axis=(0, 1)) / n
        return self

    def _sums(self, vectors: DataFrame) -> pd.DataFrame:
        match = self._match()

        def run(batches):
            for b in batches:
                v = np.stack(b["vector"].map(np.asarray)).astype(float)
                node = match(v)
                used = np.unique(node)
                yield pd.DataFrame({"node": used, "n": [int((node == i).sum()) for i in used], "total": [v[node == i].sum(axis=0) for i in used]})

        part = vectors.select("vector").mapInPandas(run, "node int, n long, total array<double>")
        by = part.select("node", "n", F.posexplode("total").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        return by.groupBy("node").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total")).toPandas()

    def _match(self):
        nodes = self.nodes
        square = (nodes**2).sum(axis=1)
        return lambda v: np.argmin(square[None, :] - 2 * (v @ nodes.T), axis=1)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``(id, x, y)``: the nearest node of each row."""
        match, side = self._match(), self.side

        def run(batches):
            for b in batches:
                node = match(np.stack(b["vector"].map(np.asarray)).astype(float)) if len(b) else np.zeros(0, dtype=int)
                yield pd.DataFrame({"id": b["id"], "x": node // side, "y": node % side})

        return vectors.select(F.col("id").cast("long"), "vector").mapInPandas(run, "id long, x int, y int")

    def neighbour_distances(self) -> np.ndarray:
        """Mean distance of each node to the nodes beside it."""
        g = self.nodes.reshape(self.side, self.side, -1)
        out = np.zeros((self.side, self.side))
        for x in range(self.side):
            for y in range(self.side):
                box = g[max(0, x - 1) : x + 2, max(0, y - 1) : y + 2].reshape(-1, g.shape[2])
                out[x, y] = np.sqrt(((box - g[x, y]) ** 2).sum(axis=1)).sum() / (len(box) - 1)
        return out


class SetMap:
    """A square grid whose nodes hold sets, trained in rounds over rows of sets.

    A node is as similar to a set as the mean, over the sets it holds, of the share of the smaller of the two that both
    have. That sum goes item by item: for an item and a set of ``s`` items, a held set of ``t`` items that has it counts 1 over the smaller of
    ``s`` and ``t``. After each round a node holds the sets that were matched to the nodes within a square that shrinks to
    itself. A set counts once, at the node it was matched to, by item and size; a set's sums with those are one join on items,
    and a node's sum is that of the nodes in its square: no two sets are compared, and no set is copied to the nodes that hold it.
    """

    def __init__(self, side: int = 24, rounds: int = 5, width: int = 8, digits: int = 9):
        self.side, self.rounds, self.width, self.digits = side, rounds, width, digits
        #: ``(node, item, size, n)`` of the sets matched to each node, ``(node, sets)``, how many a node holds, and the square's width.
        self.held: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.reach = 0

    def fit(self, sets: DataFrame) -> SetMap:
        """``sets(id, item)``. At first each node holds one random set of the mean number of items."""
        own = self._sized(sets)
        facts = own.agg(F.count_distinct("id").alias("rows"), F.count_distinct("item").alias("items")).first()
        if not facts["rows"]:
            return self
        size = max(1, facts["items"] // facts["rows"])
        first = self._first(own, size)
        self._hold(first.select(F.col("node").alias("id"), "node").distinct(), self._sized(first.select(F.col("node").alias("id"), "item")), 0)
        for step in range(self.rounds):
            matched = settled(self._matched(own))
            self._hold(matched, own, int(self.width * (1 - (step + 1) / self.rounds)))
        return self

    @staticmethod
    def _sized(sets: DataFrame) -> DataFrame:
        """``(id, item, size)``: every item of a set once, beside how many it has."""
        own = settled(sets.select("id", "item").distinct())
        return settled(own.join(own.groupBy("id").agg(F.count(F.lit(1)).alias("size")), "id"), own)

    def _first(self, own: DataFrame, size: int) -> DataFrame:
        """Items of each node: those of the ``size`` smallest hashes, of the items within a bound on the hash that leaves enough."""
        items = own.select("item").distinct()
        total = items.count()
        drawn = items.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(self.side * self.side - 1)))).withColumn("h", F.md5(F.concat_ws(":", "node", "item")))
        bound = min(1.0, (2 * size + 32) / total)
        near = drawn.where(F.conv(F.substring("h", 1, 12), 16, 10).cast("double") <= bound * 2.0**48)
        taken = numbered(near, ["node"], [F.col("h"), F.col("item")]).where(F.col("rank") <= size)
        return settled(taken.select("node", "item"))

    def _box(self, node, width: int):
        x, y = F.floor(node / self.side), node % self.side
        low = lambda c: F.greatest(c - width, F.lit(0)).cast("int")
        high = lambda c: F.least(c + width, F.lit(self.side - 1)).cast("int")
        return F.flatten(F.transform(F.sequence(low(x), high(x)), lambda a: F.transform(F.sequence(low(y), high(y)), lambda b: (a * self.side + b).cast("int"))))

    def _hold(self, matched: DataFrame, own: DataFrame, width: int) -> None:
        """From now on the nodes within ``width`` of the node of ``matched(id, node)`` hold a set."""
        here = matched.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        sets = settled(here.withColumn("node", F.explode(self._box(F.col("node"), width))).groupBy("node").agg(F.sum("n").alias("sets")))
        self.held = settled(own.join(matched.select("id", "node"), "id").groupBy("node", "item", "size").agg(F.count(F.lit(1)).alias("n")))
        self.sets, self.reach = sets, width

    def _matched(self, own: DataFrame) -> DataFrame:
        """``(id, node, similarity)``: the most similar node, the first of equal ones; a set like none goes to the first node that holds nothing, or to the first."""
        met = own.withColumnRenamed("size", "s").join(self.held.withColumnRenamed("size", "t"), "item")
        at = met.groupBy("id", "node").agg(F.sum(F.col("n") / F.least("s", "t")).alias("shared")).repartition("id")  # a row an id and node at most
        near = at.select("id", F.explode(self._box(F.col("node"), self.reach)).alias("node"), "shared").groupBy("id", "node").agg(F.sum("shared").alias("shared"))
        near = near.join(F.broadcast(self.sets), "node").select("id", "node", F.round(F.col("shared") / F.col("sets"), self.digits).alias("similarity"))
        best = near.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("node")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("node"), "b.similarity")
        grid = own.sparkSession.range(self.side * self.side).select(F.col("id").cast("int").alias("node"))
        empty = grid.join(self.sets, "node", "left_anti").agg(F.coalesce(F.min("node"), F.lit(0)).alias("spare"))
        out = own.select("id").distinct().join(best, "id", "left").crossJoin(F.broadcast(empty))
        return out.select("id", F.coalesce("node", "spare").cast("int").alias("node"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))

    def assign(self, sets: DataFrame) -> DataFrame:
        """``(id, x, y, similarity)``: the node of each set."""
        own = self._sized(sets)
        if self.held is None:
            return own.select("id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0.0).alias("similarity")).limit(0)
        return self._matched(own).select("id", F.floor(F.col("node") / self.side).cast("int").alias("x"), (F.col("node") % self.side).alias("y"), "similarity")

    def medians(self, sets: DataFrame) -> DataFrame:
        """``(x, y, id, size)``: of the sets matched to each node, the one in the middle by size, then by id."""
        own = self._sized(sets)
        at = self.assign(own).join(own.select("id", "size").distinct(), "id")
        placed = settled(numbered(settled(at), ["x", "y"], [F.col("size"), F.col("id")]))
        count = placed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        return placed.join(count, ["x", "y"]).where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("x", "y", "id", "size")
