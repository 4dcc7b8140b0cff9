"""Term hierarchies ``(child, parent)``: descendants by frontier joins, safe on shared parents and on cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import remove, settled


def descendants(edges: DataFrame, roots: DataFrame, recursive: bool = True, with_roots: bool = False, max_depth: int | None = None) -> DataFrame:
    """``(root, term, depth)`` of all terms under each root, at their least depth; ``max_depth`` goes no further.

    A term comes in once, so the search ends on any hierarchy, and levels stay as they were written.
    """
    e = settled(edges.select("child", "parent").distinct())
    levels = [settled(roots.select(F.col("root"), F.col("root").alias("term"), F.lit(0).alias("depth")).distinct())]
    deepest = max_depth if recursive else 1
    while deepest is None or len(levels) <= deepest:
        step = levels[-1].join(e, levels[-1]["term"] == e["parent"]).select("root", F.col("child").alias("term")).distinct()
        seen = reduce(DataFrame.union, [x.select("root", "term") for x in levels])
        fresh = settled(step.join(seen, ["root", "term"], "left_anti").withColumn("depth", F.lit(len(levels))))
        if fresh.isEmpty():
            remove(fresh)
            break
        levels.append(fresh)
    found = reduce(DataFrame.union, levels)
    return found if with_roots else found.where("depth > 0")


def keys_under(annotation: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, key)``: keys annotated with a root or anything under it."""
    under = descendants(edges, roots, with_roots=True)
    return annotation.join(under, "term").select("root", "key").distinct()


def keys_outside(annotation: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys with no annotation under any of the roots."""
    return annotation.select("key").distinct().join(keys_under(annotation, edges, roots).select("key").distinct(), "key", "left_anti")


def subset(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges among a root's terms."""
    under = descendants(edges, roots, with_roots=True).select("term").distinct()
    return edges.join(under.withColumnRenamed("term", "child"), "child", "left_semi").join(under.withColumnRenamed("term", "parent"), "parent", "left_semi").select("child", "parent")
