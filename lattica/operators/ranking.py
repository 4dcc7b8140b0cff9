"""Running sums and places over raw rows, by range parts instead of one window a key.

Rows are dealt out by range of key and order, summed inside their part, and offset by what the key has in earlier parts;
so one key may hold any share of the rows. Only a row a part and key is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut, shuffle_width


def running_sums(df: DataFrame, by: list[str], order: list[Column], **sums: str | Column) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum of its expression over the rows of the same ``by`` up to this one.

    ``order`` should part all rows of a key, or rows that it does not part come in any order.
    """
    width = shuffle_width(df.sparkSession)
    values = {f"_v_{n}": F.expr(e) if isinstance(e, str) else e for n, e in sums.items()}
    dealt = df.withColumns(values).repartitionByRange(width, *[F.col(c) for c in by], *order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part", *by).agg(*[F.sum(v).alias(v.replace("_v_", "_s_")) for v in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", *by, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    same = [summed[c].eqNullSafe(sizes[c]) for c in by]
    condition = summed["_part"] == sizes["_part"]
    for s in same:
        condition = condition & s
    met = summed.join(F.broadcast(sizes) if not by else sizes, condition)
    return met.select(*[summed[c] for c in df.columns], *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows of each key numbered from 1 in ``order``."""
    return running_sums(df, by, order, **{name: F.lit(1).cast("long")})
