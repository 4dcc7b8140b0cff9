"""Queries against rows in cells: a bounded group of rows is held, and its queries stream past it.

Rows are dealt into groups of bounded size, and the queries that a group has to answer come after its rows in the same
sorted partition. Memory is bounded by one group of rows and a few hundred queries however many rows or queries there
are, and a row travels once for every ``queries_per_cell`` queries of its group, not once for every few hundred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, and neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def merge_best(found: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The ``k`` best of ``(query_id, vec_id, score)`` for each query with ranks, ties to the smaller vec_id.

    Best lists are merged in two steps, so that no task holds more than the lists of one query's share of groups.
    """
    order = F.col("score") if ascending else -F.col("score")
    item = F.struct(order.alias("o"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))
    part = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("best"))
    whole = part.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = whole.select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], fn: Callable[..., pd.DataFrame], schema: str, dtype=np.float64, at_once: int = 512) -> DataFrame:
    """``fn(ids, matrix, query_ids, query_matrix, floors)`` for every cell and every ``at_once`` of its queries.

    Both sides hold ``keys``, ``vec_id``, ``v`` and ``floor``; one shuffle on the keys brings them together.
    """
    columns = [*keys, "side", "vec_id", "v", "floor"]
    both = rows.withColumn("side", F.lit(0)).select(columns).union(queries.withColumn("side", F.lit(1)).select(columns))
    matrix = lambda part: np.stack([np.asarray(v, dtype=dtype) for v in part["v"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, parts, held = None, [], None
        for batch in batches:
            at = np.flatnonzero((batch[[*keys, "side"]].to_numpy()[1:] != batch[[*keys, "side"]].to_numpy()[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *at], [*at, len(batch)]):
                part = batch.iloc[a:b]
                own = tuple(part[keys].iloc[0])
                if own != cell:
                    cell, parts, held = own, [], None
                if part["side"].iloc[0] == 0:
                    parts.append((part["vec_id"].to_numpy(), matrix(part)))
                    continue
                if held is None and parts:
                    held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    parts = []
                if held is None:
                    continue
                for i in range(0, len(part), at_once):
                    some = part.iloc[i : i + at_once]
                    yield fn(*held, some["vec_id"].to_numpy(), matrix(some), some["floor"].to_numpy())

    return both.repartition(*keys).sortWithinPartitions(*keys, "side").mapInPandas(run, schema)
