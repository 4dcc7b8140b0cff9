"""N-gram Jaccard join by MinHash banding.

1. Each text becomes its set of five-word shingles; equal sets collapse to one node, whose representative is the
   smallest doc_id.
2. Band and row counts are chosen for a target recall at the threshold; representatives meet on band hashes, each
   linked to the smallest one of its bucket only, so a bucket costs as many links as it has members.
3. Components of these links are candidate clusters. A cluster of more than ``block`` members is split into blocks by
   hash, and every two blocks meet in one group, so no task holds more than about two blocks. What travels are the
   shingles' hashes, worked out once for each member.
4. Groups verify all their pairs on full shingle sets and give counts of links and spanning links, never the pairs.

Defined results: a null text is an empty one; texts without words have no link and are a class of their own; rows with
a null doc_id take no part and come back with null class and 0 links; repeated rows count as documents of their own, so
two like rows of one doc_id link, and unlike texts under one doc_id go their own ways; extra columns are ignored. ``n_links`` counts the other documents at or above the
threshold, copies included; ``class_id`` is the smallest doc_id that a chain of links reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lattica.llm.common import map_sorted_groups, portions
from lattica.llm.shingles import hash_family, min_hashes, mix, set_key, shingle_sets
from lattica.operators.components import connected_components
from lattica.session import cut, table

SIGNATURE = "doc_id long, k1 long, k2 long, n_shingles int, bands array<long>"


def choose_bands(threshold: float, target_recall: float, rows: int = 5) -> int:
    """The fewest bands of ``rows`` hashes that catch a pair at ``threshold`` with probability ``target_recall``."""
    return max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows)))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row a document: the 128-bit name of its shingle set, the set's size and its band hashes."""

    def run(batches):
        a, b = hash_family(bands * rows)
        place = mix(np.arange(bands, dtype=np.uint64) + np.uint64(99))
        weight = mix(np.arange(rows, dtype=np.uint64) + np.uint64(7777)) | np.uint64(1)
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for start, stop in portions([len(t) if t else 0 for t in texts]):
                sets = shingle_sets(texts[start:stop], width)
                keys = [set_key(s) if len(s) else (0, 0) for s in sets]
                hashes = [mix((min_hashes(s, a, b).reshape(bands, rows) * weight).sum(axis=1, dtype=np.uint64) ^ place).astype(np.int64) if len(s) else None for s in sets]
                yield pd.DataFrame({"doc_id": ids[start:stop], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "n_shingles": [len(s) for s in sets], "bands": hashes})

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInPandas(run, SIGNATURE)


def _verify(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
        sets = [np.frombuffer(b, dtype="<u8") for b in group["shingles"]]
        own = group["own"].to_numpy()
        node, docs = group["node"].to_numpy(), group["n_docs"].to_numpy()
        size = np.array([len(s) for s in sets])
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        shared = _overlaps([sets[x] for x in left], [sets[x] for x in right])
        similar = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
        if i == j:
            np.fill_diagonal(similar, False)
        links = np.zeros(len(group), dtype=np.int64)
        links[left] += similar @ docs[right]
        if i != j:
            links[right] += similar.T @ docs[left]
        touch = {x: right[row] for x, row in zip(left, similar)}
        low = pd.Series(node).groupby(_roots(np.arange(len(group)), touch)).transform("min").to_numpy()
        hit = (links > 0) | (low != node)
        return pd.DataFrame({"node": node[hit], "low": low[hit], "links": links[hit]})

    return run


def _roots(root: np.ndarray, touch: dict[int, np.ndarray]) -> np.ndarray:
    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, others in touch.items():
        for y in others:
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(len(root))], dtype=np.int64)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], slice_size: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of incidence slices over shared shingles."""
    common = np.intersect1d(np.concatenate(left) if left else [], np.concatenate(right) if right else [])
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(common), slice_size):
        part = common[at : at + slice_size].astype(np.uint64)

        def incidence(sets):
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for x, s in enumerate(sets):
                lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], side="right")
                p = np.searchsorted(part, s[lo:hi])
                p = p[part[p] == s[lo:hi]] if len(p) else p
                m[x, p] = 1
            return m

        total += incidence(left) @ incidence(right).T
    return total.astype(np.int64)


def _with_nodes(sets: DataFrame) -> DataFrame:
    """Adds ``node``, one number a set: the smallest doc_id that holds it, and a hash where that doc_id is the smallest of several sets."""
    shared = cut(sets.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.lit(True).alias("_shared")))
    if shared.isEmpty():
        return sets.withColumn("node", F.col("rep"))
    marked = sets.join(shared, "rep", "left")
    for seed in range(20):
        named = cut(marked.withColumn("node", F.when(F.col("_shared"), F.xxhash64("k1", "k2", F.lit(seed))).otherwise(F.col("rep"))).drop("_shared"))
        if named.groupBy("node").count().where("count > 1").isEmpty():
            return named
    raise RuntimeError("sets of repeated doc_ids found no numbers of their own")


def _member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` with the hashes of their shingles. A doc_id's texts that are not the member's set drop out."""
    keep = ["component", "blocks", "node", "n_docs", "own"]
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null and text is not null").join(members, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in portions(pc.binary_length(batch.column("text")).to_pylist()):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                own = [i for i, (s, *key) in enumerate(zip(sets, part.column("k1").to_pylist(), part.column("k2").to_pylist())) if len(s) and list(set_key(s)) == key]
                part = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([sets[i].astype("<u8").tobytes() for i in own], pa.binary())], names=[*keep, "shingles"])

    found = texts.select("text", "k1", "k2", *keep).mapInArrow(run, "component long, blocks int, node long, n_docs long, own int, shingles binary")
    return found


def _set_classes(docs: DataFrame, sig: DataFrame, threshold: float, width: int, block: int) -> DataFrame:
    """``(k1, k2, rep, component, n_links)``: every set of at least one shingle, the class it is in and the documents linked to its own."""
    full = sig.where("n_shingles > 0")
    reps = cut(_with_nodes(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"))))
    firsts = full.join(reps.select("k1", "k2", F.col("rep").alias("doc_id"), "node"), ["k1", "k2", "doc_id"])
    again = not firsts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()  # whole rows come more than once
    hashed = (firsts.dropDuplicates(["node"]) if again else firsts).select("node", F.explode("bands").alias("h"))
    buckets = hashed.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("h", "low")
    links = hashed.join(buckets, "h").where("node <> low").select("node", "low")
    cluster = cut(connected_components(links, "node", "low"))
    sizes = cluster.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = cluster.join(sizes, "component").join(reps, "node")
    members = members.select("component", "blocks", "node", "rep", "n_docs", "k1", "k2", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    work = _member_sets(docs, members, width)
    work = cut(work.dropDuplicates(["node"]) if again else work).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n_docs", "shingles")
    found = cut(map_sorted_groups(work, ["component", "lo", "hi"], _verify(threshold), "node long, low long, links long"))
    classes = connected_components(found, "node", "low")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = reps.join(classes, "node", "left").join(counts, "node", "left")
    return named.select("k1", "k2", "rep", F.coalesce("component", "node").alias("component"), (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, target_recall: float = 0.9999, rows: int = 5, block: int = 256) -> DataFrame:
    """``(doc_id, class_id, n_links)``, one row for each row of ``docs(doc_id, text, ...)``."""
    sig = cut(signatures(docs, width, choose_bands(threshold, target_recall, rows), rows))
    sets = cut(_set_classes(docs, sig, threshold, width, block))
    named = sets.join(sets.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("k1", "k2", "class_id", "n_links")
    out = sig.where("n_shingles > 0").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    empty = sig.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(empty).union(unnamed)


def one_of_each_group(docs: DataFrame, threshold: float = 0.8, width: int = 5, target_recall: float = 0.9999, rows: int = 5, block: int = 256) -> DataFrame:
    """``docs`` with one row of each class: of its smallest doc_id. Rows with a null doc_id, and those without words, stay.

    Where a doc_id has several rows, each goes by its own text: a row that is in no other's class is not lost.
    """
    sig = cut(signatures(docs, width, choose_bands(threshold, target_recall, rows), rows))
    sets = _set_classes(docs, sig, threshold, width, block)
    first = cut(sets.groupBy("component").agg(F.min(F.struct("rep", "k1", "k2")).alias("f")).select("f.*"))
    several = cut(sig.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    stay = first.select(F.col("rep").alias("doc_id")).union(sig.where("n_shingles = 0").select("doc_id"))
    if several.isEmpty():
        drop = sig.select("doc_id").join(stay, "doc_id", "left_anti")
        return docs.join(drop, "doc_id", "left_anti")
    single = docs.join(several, "doc_id", "left_anti")
    single = single.where("doc_id is null").unionByName(single.join(stay, "doc_id", "left_semi").select(*docs.columns))
    twice = docs.join(several, "doc_id", "left_semi").select(F.col("doc_id").cast("long"), "text", F.struct(*[F.col(c).alias(c) for c in docs.columns]).alias("row"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_key(s) if len(s) else (None, None) for s in shingle_sets(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array([k[i] for k in found], pa.int64()) for i in (0, 1))], names=["doc_id", "row", "k1", "k2"])

    schema = StructType([*twice.select("doc_id", "row").schema.fields, StructField("k1", LongType()), StructField("k2", LongType())])
    keyed = cut(twice.select("doc_id", "row", "text").mapInArrow(keys, schema))
    chosen = keyed.join(first.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    return single.unionByName(keyed.where("k1 is null").unionByName(chosen).select("row.*"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of the whole ``documents`` table: its class and its number of links."""
    return jaccard_join(table(spark, sf_dir, "documents"))
