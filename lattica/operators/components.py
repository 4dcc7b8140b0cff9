"""Connected components by alternating large-star and small-star steps.

Every step is a map-side combined ``min`` per node and one equi-join whose hubs
adaptive execution splits, so none is gathered in one task; a round at least halves the depth of the trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import cut, settled

#: A round's pairs are written in no more files than hold this many of the round before.
ROWS_A_FILE = 20_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _apart(low: DataFrame) -> DataFrame:
    """Deal the row a node out by another key, so that the join that follows has a shuffle on either side and adaptive execution can split a hub's edges."""
    return low.repartition(F.xxhash64("u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; ``component`` is the smallest node.

    Self-loops and repeated edges are harmless; a node with only a self-loop is its own component.
    Rows with a null end are ignored, an empty list gives an empty result.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    alone = raw.where("u = v").select(F.col("u").alias("node"))
    pairs = cut(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).union(alone).distinct()
    before = _fingerprint(pairs)
    for i in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = new.coalesce(max(1, -(-before[0] // ROWS_A_FILE)))  # few pairs do not make many small files; many are not put together
        pairs = settled(new) if i % 6 == 5 else cut(new)  # guesses of size multiply by joins: every sixth round starts from the true one
        now = _fingerprint(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("root", "node").alias("component"))


def dealt_by_component(edges: DataFrame, width: int, most_links: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``edges(src, dst, ...)`` with a ``deal`` below ``width`` that is one for a component, and the rows of components of more than ``most_links`` of them."""
    keyed = settled(edges.join(connected_components(edges).withColumnRenamed("node", "src"), "src"))
    large = settled(keyed.groupBy("component").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > most_links).select("component"))
    small = keyed.join(large, "component", "left_anti").select(*edges.columns, F.pmod(F.xxhash64("component"), F.lit(width)).cast("int").alias("deal"))
    return small, keyed.join(large, "component", "left_semi").select(*edges.columns)
