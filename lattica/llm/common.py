"""What the text operators share: held-out rows, bounded samples and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOLDS = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows that no model may learn labels from: crc32 of the id's text, modulo 5, is 0. A null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows ``(doc_id, y)`` outside the held-out fold, drawn by hash of the id: the same rows on every run."""
    rows = labels.where(~held_out()).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.col(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows).groupBy("doc_id").agg(F.max("y").alias("y"))


def both_classes(rows: DataFrame, least: int = 5) -> bool:
    """Whether ``rows(y)`` hold at least ``least`` of either class, enough to calibrate a score on."""
    found = rows.agg(F.count(F.when(F.col("y") == 1, 1)).alias("ones"), F.count(F.when(F.col("y") == 0, 1)).alias("zeros")).first()
    return min(found["ones"], found["zeros"]) >= least


def stream_groups(batches: Iterator[pd.DataFrame], keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply ``fn`` to each run of equal ``keys`` in rows that come sorted by them; only one group is held at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if held and any(held[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values)):
            starts = np.concatenate([[0], starts])
        at = 0
        out = []
        for s in starts:
            if s > at:
                held.append(batch.iloc[at:s])
            if held:
                out.append(fn(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
                held = []
            at = s
        held.append(batch.iloc[at:])
        out = [x for x in out if len(x)]
        if out:
            yield pd.concat(out, ignore_index=True)
    if held:
        yield fn(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))


def map_sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One shuffle on ``keys``, then ``fn`` on each group. The caller bounds the size of a group."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda it: stream_groups(it, keys, fn), schema)


def map_texts(docs: DataFrame, keep: list[str], make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], schema: str, chars: int = 1 << 20) -> DataFrame:
    """The columns ``keep`` as they are, then those that ``make()`` derives from the texts; one row a row.

    Rows come and go as Arrow columns, so a 64-bit id beside a null stays what it is. A batch is worked on in runs of
    whole texts of about ``chars`` characters, so that what is derived stays small however long the texts are.
    """
    names = [f.name for f in _schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start, stop in portions(pc.binary_length(batch.column("text")).to_pylist(), chars):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *work(part.column("text").to_pylist())], names=names)

    return docs.select(*[F.col(k).cast(t.dataType) for k, t in zip(keep, _schema(schema))], F.col("text").alias("text")).mapInArrow(run, schema)


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def portions(lengths: list[int | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole texts, given their ``lengths``, of about ``chars`` together."""
    start, size = 0, 0
    for i, own in enumerate(lengths):
        own = own or 0
        if i > start and size + own > chars:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(lengths):
        yield start, len(lengths)


class ByteMemo:
    """What was worked out for strings, in two generations of at most ``limit`` bytes each: the older one goes when the newer is full."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def split(self, keys) -> tuple[dict[str, object], list[str]]:
        """What is known of ``keys``, and the keys that are not."""
        new, old = self.new, self.old
        known = {k: new[k] for k in keys if k in new}
        if len(known) == len(keys):
            return known, []
        rest = [k for k in keys if k not in known]
        again = {k: old[k] for k in rest if k in old}
        self.keep(again)
        known |= again
        return known, [k for k in rest if k not in again]

    def keep(self, found: dict[str, object], own_bytes: int = 0) -> None:
        """Remember ``found``, whose values take ``own_bytes`` beside 250 for each entry and the keys' letters."""
        size = own_bytes + 250 * len(found) + 2 * sum(map(len, found))
        if size > self.limit:
            return
        if self.size + size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new |= found
        self.size += size


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps; with one class only, the intercept says so."""
    a = np.column_stack([np.ones(len(x)), x]).astype(float)
    w = np.zeros(a.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[0] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    ridge = np.full(a.shape[1], l2)
    ridge[0] = 1e-9
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) / len(y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
