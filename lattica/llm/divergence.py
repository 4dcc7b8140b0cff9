"""How far the sources of a language lie apart in their words: a heavy-light split over exact whole numbers.

A group is a language and a source. A language keeps the terms of enough of its documents, and a group's share of a term is
a whole number of billionths, smoothed, so it is known where the group hasn't the term: its base share. Two groups differ by
the sum over all kept terms of ``floor((p - q)^2 / (p + q))``. Most terms are in few groups, so most summands are of two base
shares. The sum is put together from parts, all of them whole numbers:

- heavy terms, in a quarter of a language's groups or more, or in more than ``MOST_POSTINGS``: dense tiles, a block of terms
  by two blocks of groups, as arrays;
- light terms, as if no two groups shared one: base against base for each, and the change for those that one group has,
  by how many terms it has of each share (tiles of two blocks of groups again);
- light terms that two groups share: corrections from the term's list of groups, which has ``MOST_POSTINGS`` entries at most.

A null text, lang or source is read as ''. A text without terms still makes its group occur. Repeated rows are documents of
their own. An empty table gives no rows. Extra columns are ignored. The result has a row for every two sources of a language,
so lists of a language's groups, and of a group's distances, are smaller than the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import map_sorted_groups, portions
from lattica.session import cut, table

LEAST_DOCS = 10
TOP = 10
MOST_POSTINGS = 64
#: Groups and (about) terms on the sides of a dense tile.
SIDE, TALL = 64, 512
RUN_BYTES = 4 << 20

_DOC = b"\xff"  # a byte that no text in UTF-8 has
_OTHER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_PLAIN = bytes.maketrans(_OTHER + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_OTHER) + b"abcdefghijklmnopqrstuvwxyz")


def _runs(texts: list[bytes | None], run_bytes: int = RUN_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Terms in order with marks between documents, the number of the document of each, and which are marks; a long text comes in parts, cut between terms."""
    for start, stop in portions([len(t) if t else 0 for t in texts], run_bytes):
        whole = (b" " + _DOC + b" ").join((t or b"").translate(_PLAIN) for t in texts[start:stop])
        at, doc = 0, 0
        while at < len(whole):
            end = min(at + 2 * run_bytes, len(whole))
            if end < len(whole):
                found = whole.find(b" ", end)
                end = len(whole) if found < 0 else found
            tokens = whole[at:end].split()
            mark = np.fromiter((t == _DOC for t in tokens), dtype=bool, count=len(tokens))
            own = doc + np.cumsum(mark)
            if len(own):
                doc = int(own[-1])
            yield tokens, start + own, mark
            at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)`` for every term of every group, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
            keys: dict[tuple[str, str], int] = {}
            group = np.array([keys.setdefault(k, len(keys)) for k in zip(*(names[c].to_pylist() for c in ("lang", "source")))], dtype=np.int64)
            lang, source = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            last_doc, last_terms = -1, pa.array([], pa.binary())  # of a text that comes in parts: what its earlier parts had
            for tokens, doc, mark in _runs(texts):
                if not tokens:
                    continue
                d = pa.array(tokens, pa.binary()).dictionary_encode()
                ids = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)[~mark]
                doc = doc[~mark]
                if not len(ids):
                    continue
                size = len(d.dictionary)
                each, n = np.unique(doc * size + ids, return_counts=True)
                at, term = each // size, each % size
                new = np.ones(len(each), dtype=np.int64)
                if at[0] == last_doc:
                    new[(at == last_doc) & np.isin(term, pc.index_in(last_terms, d.dictionary).drop_null().to_numpy())] = 0
                ends = d.dictionary.take(pa.array(term[at == at[-1]]))
                last_terms = pa.concat_arrays([last_terms, ends]).unique() if at[-1] == last_doc else ends
                last_doc = at[-1]
                code, back = np.unique(group[at] * size + term, return_inverse=True)
                count, has = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=np.int64)
                np.add.at(count, back, n)
                np.add.at(has, back, new)
                g = pa.array(code // size)
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), d.dictionary.take(pa.array(code % size)).cast(pa.string()), pa.array(count), pa.array(has)], ["lang", "source", "term", "count", "docs"])

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), in decimals: products may pass 64 bits."""
    top = (count.cast("decimal(19,0)") + 2) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(19,0)")) + F.lit(1).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares pass a billion by one at most, so squares stay within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tiles(rows: DataFrame, *columns: str) -> DataFrame:
    """Each group's row for every tile ``(a, b)``, a <= b, that its block of groups has a side in."""
    own = F.call_function("div", F.col("g"), F.lit(SIDE))
    pair = lambda other: F.struct(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"))
    blocks = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("groups") - 1, F.lit(SIDE)))
    return rows.withColumn("_t", F.explode(F.transform(blocks, pair))).select("lang", F.col("_t.a").alias("a"), F.col("_t.b").alias("b"), *columns)


_PAIRS = "lang string, g long, h long, value long"


def _pair_rows(lang: str, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """The tile's values for g < h."""
    i, j = np.nonzero(left[:, None] < right[None, :])
    return pd.DataFrame({"lang": lang, "g": left[i], "h": right[j], "value": value[i, j]})


def _sides(base: pd.DataFrame, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups of the tile's two blocks."""
    g = np.sort(base["g"].unique())
    return g[g // SIDE == a], g[g // SIDE == b]


def _dense(tile: pd.DataFrame) -> pd.DataFrame:
    """Sum of what a tile's terms differ by between every two groups; a group without a term has its base share."""
    lang, a, b = tile["lang"].iloc[0], tile["a"].iloc[0], tile["b"].iloc[0]
    is_base = tile["term"].isna().to_numpy()
    base, own = tile[is_base], tile[~is_base]
    left, right = _sides(base, a, b)
    groups = np.unique(np.concatenate([left, right]))
    base = base.drop_duplicates("g").sort_values("g")
    term, names = pd.factorize(own["term"])
    p = np.repeat(base["p"].to_numpy()[None, :], len(names), axis=0)
    p[term, np.searchsorted(groups, own["g"].to_numpy())] = own["p"].to_numpy()
    value = np.zeros((len(left), len(right)), dtype=np.int64)
    q = p[:, np.searchsorted(groups, right)]
    for i, x in enumerate(np.searchsorted(groups, left)):
        value[i] = _apart(p[:, x : x + 1], q).sum(axis=0)
    return _pair_rows(lang, left, right, value)


def _one_sided(tile: pd.DataFrame) -> pd.DataFrame:
    """Light terms as if no two groups shared one. Rows with ``n`` are a group's number of light terms of share ``p``; others are its base."""
    lang, a, b = tile["lang"].iloc[0], tile["a"].iloc[0], tile["b"].iloc[0]
    is_base = tile["n"].isna().to_numpy()
    base, own = tile[is_base].drop_duplicates("g").sort_values("g"), tile[~is_base].drop_duplicates(["g", "p"])
    left, right = _sides(base, a, b)
    groups, p0, light = base["g"].to_numpy(), base["p"].to_numpy(), base["light"].to_numpy()
    l, r = np.searchsorted(groups, left), np.searchsorted(groups, right)
    none = _apart(p0[l][:, None], p0[r][None, :])
    value = none * light[l][:, None]
    for g, p, n in zip(own["g"].to_numpy(), own["p"].to_numpy(), own["n"].to_numpy().astype(np.int64)):
        if g // SIDE == a:
            i = np.searchsorted(left, g)
            value[i] += n * (_apart(p, p0[r]) - none[i])
        if g // SIDE == b:
            j = np.searchsorted(right, g)
            value[:, j] += n * (_apart(p, p0[l]) - none[:, j])
    return _pair_rows(lang, left, right, value)


def _shared(light: DataFrame) -> DataFrame:
    """Corrections for light terms that two groups share, from ``(lang, own)``, summed a few terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            names, at = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
            lists = batch.column("own")
            offsets = lists.offsets.to_numpy()
            values = lists.values
            g, p, base = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = np.diff(offsets)
            for k in np.unique(sizes[sizes > 1]):
                i, j = np.triu_indices(k, 1)
                rows = np.flatnonzero(sizes == k)
                step = max(1, 500_000 // len(i))
                for s in range(0, len(rows), step):
                    own = rows[s : s + step]
                    x, y = (offsets[own][:, None] + side[None, :] for side in (i, j))
                    fix = _apart(p[x], p[y]) - _apart(p[x], base[y]) - _apart(base[x], p[y]) + _apart(base[x], base[y])
                    low, high = np.minimum(g[x], g[y]), np.maximum(g[x], g[y])
                    found = pd.DataFrame({"l": np.repeat(at[own], len(i)), "g": low.ravel(), "h": high.ravel(), "value": fix.ravel()}).groupby(["l", "g", "h"], as_index=False)["value"].sum()
                    yield pa.RecordBatch.from_arrays([pa.array([names[v] for v in found["l"]], pa.string()), *(pa.array(found[c].to_numpy(), pa.int64()) for c in ("g", "h", "value"))], ["lang", "g", "h", "value"])

    return light.select("lang", "own").mapInArrow(run, _PAIRS)


def audit_tables(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """``(lang, g, source, groups, total, terms, base)``, a row a group, and ``(lang, term, total, k, own)``, a row a kept term.

    ``own`` lists the term's groups with their counts.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    in_lang = Window.partitionBy("lang")
    groups = named.select("lang", "source").distinct()
    groups = cut(groups.select("lang", "source", (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("g"), F.count(F.lit(1)).over(in_lang).alias("groups")))
    # Dealt by another key, so that the counts of a large group can be split in the join.
    counted = count_terms(named).join(groups.repartition(F.xxhash64("g", "lang")), ["lang", "source"])
    each = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("g", "count"))).alias("own"))
    kept = cut(each.where(F.col("docs") >= least_docs).select("lang", "term", "total", F.size("own").alias("k"), "own"))
    sums = kept.select("lang", F.explode("own").alias("o")).groupBy("lang", "o.g").agg(F.sum("o.count").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    known = groups.join(terms, "lang", "left").join(sums, ["lang", "g"], "left").na.fill(0, ["terms", "total"])
    base = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    return cut(known.select("lang", "g", "source", "groups", "total", "terms", base.alias("base"))), kept


def shares(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, term, g, p, base, q, heavy)`` for every term and group that has it; ``q`` is the language's share."""
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("terms").alias("lang_terms"), F.max("groups").alias("lang_groups"))
    heavy = (F.col("k") * 4 >= F.col("lang_groups")) | (F.col("k") > MOST_POSTINGS)
    t = kept.join(langs, "lang").select("lang", "term", share(F.col("total"), F.col("lang_total"), F.col("lang_terms")).alias("q"), heavy.alias("heavy"), F.explode("own").alias("o"))
    own = groups.select("lang", "g", F.col("total").alias("group_total"), "terms", "base").repartition(F.xxhash64("g", "lang"))
    met = t.select("lang", "term", "q", "heavy", "o.g", "o.count").join(own, ["lang", "g"])
    return met.select("lang", "term", "g", share(F.col("count"), F.col("group_total"), F.col("terms")).alias("p"), "base", "q", "heavy")


def distances(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """``(lang, g, h, value)`` with g < h, for every two groups of a language."""
    sides = groups.select("lang", "g", "groups", F.col("base").alias("p"))
    heavy = posted.where("heavy").join(groups.select("lang", "g", "groups").repartition(F.xxhash64("g", "lang")), ["lang", "g"])
    many = posted.where("heavy").groupBy("lang").agg(F.count_distinct("term").alias("n"))
    chunks = cut(many.select("lang", F.ceil(F.col("n") / TALL).alias("chunks")))
    tall = heavy.join(chunks.repartition(F.xxhash64("lang")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    tall = _tiles(tall, "chunk", "term", "g", "p")
    bases = sides.join(chunks, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    bases = _tiles(bases.withColumn("term", F.lit(None).cast("string")), "chunk", "term", "g", "p")
    dense = map_sorted_groups(tall.union(bases), ["lang", "chunk", "a", "b"], _dense, _PAIRS)

    light = posted.where(~F.col("heavy"))
    few = light.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("n")).join(groups.select("lang", "g", "groups"), ["lang", "g"])
    per_lang = light.groupBy("lang").agg(F.count_distinct("term").alias("light"))
    plain = sides.join(per_lang, "lang", "left").select("lang", "g", "groups", "p", F.lit(None).cast("long").alias("n"), F.coalesce("light", F.lit(0)).alias("light"))
    few = few.select("lang", "g", "groups", "p", "n", F.lit(0).cast("long").alias("light"))
    one = map_sorted_groups(_tiles(few, "g", "p", "n", "light").union(_tiles(plain, "g", "p", "n", "light")), ["lang", "a", "b"], _one_sided, _PAIRS)

    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "base")).alias("own")).where(F.size("own") > 1)
    return dense.union(one).union(_shared(lists)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source lies from each other of its language (``pair``), and the
    terms by which it stands out most from its language (``term``, ``top`` of them)."""
    groups, kept = audit_tables(docs, least_docs)
    posted = cut(shares(groups, kept))
    d = cut(distances(groups, posted))
    name = lambda g, s: groups.select("lang", F.col("g").alias(g), F.col("source").alias(s))
    both = d.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"])
    pairs = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = posted.where("p > q").select("lang", "g", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    terms = out.join(name("g", "source"), ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
tok AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS count FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(count) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.count, 0) AS count, 1 + 1000000000::HUGEINT * (coalesce(c.count, 0) + 2) // (coalesce(gn.n, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 2) // (v.n + 2 * v.v) AS q
  FROM grp g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
