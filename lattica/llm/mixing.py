"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source has a target number of words. Its documents are shuffled by a hash and laid end to end, its stream is cut
into blocks of equal length, and a source of ``n`` blocks owns ``n`` neighbouring positions of all ``N``. Position ``y`` is
used at the time that its bits give when they are read backward: van der Corput's sequence, mapped through the cumulative
numbers of blocks. So every stretch of the schedule holds each source by its share but for a few blocks. Slots of a source
are ranked by counting in closed form, without a sort, and slot ``r`` takes block ``r`` of the source's stream: one join.
A target above its source's size goes through the stream again.

Null texts and texts without words have size 0 and are taken 0 times; a null source is one source, the last; repeated rows
are documents of their own, of which equal ones are told apart by nothing but what is taken of them. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.ranking import running_sums
from lattica.session import cut, table

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 2048
#: Bits of a schedule position; 2^40 blocks of 2048 words are more than 10^15 words.
BITS = 40
CHUNK = 1 << 14

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)`` for every row, written once: the texts are read this one time."""
    return cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, no, source_size, target)``: a row a source of ``(source, size)``, numbered from 0 by code point, null last.

    Sources weigh ``weights`` in turn and part ``share`` of all sizes by weight. A target stops at ``most`` times its
    source's size and the excess goes to the others by weight, again and again: in order of size over weight, the first
    source that its part of what is left does not fill tells the level for itself and all after it.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_sums(each, [], [F.col("source").asc_nulls_last()], place=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = placed.select("source", (F.col("place") - 1).alias("no"), "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    filled = cut(running_sums(placed, [], [(F.col("cap") / F.col("w")).asc(), F.col("no")], caps="cap", ws="w"))
    total = filled.agg(F.sum("source_size").alias("all_words"), F.sum("w").alias("all_w"))
    left = (F.col("all_words") * float(share) - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w")))
    tried = filled.crossJoin(F.broadcast(total)).withColumn("level", left).where(F.col("level") <= F.col("cap") / F.col("w"))
    level = tried.agg(F.min_by("level", F.struct(F.col("cap") / F.col("w"), F.col("no"))).alias("level"))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return filled.crossJoin(F.broadcast(level)).select("source", "no", "source_size", target.alias("target"))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def earlier(y: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """How many positions of [low, high) come before position ``y`` when positions are ordered by their bits read backward.

    An earlier one has the lowest bits of ``y`` up to some set bit of ``y``, where it has a zero: one count a bit.
    """
    def step(total: Column, j: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        is_set = F.call_function("shiftright", y, j).bitwiseAND(F.lit(1).cast("long")) == 1
        before = 2 * size - 1 - F.pmod(y, size)
        found = _div(high + before, 2 * size) - _div(low + before, 2 * size)
        return F.when(is_set, total + found).otherwise(total)

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), step)


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(no, rank, slot)``: who fills each slot of the mix, and the how-manieth of its slots it is, both from 0.

    ``sources`` holds ``(no, take)``, the whole number of words to take. Positions are written out in chunks, so that no
    row and no task holds all slots of a large source.
    """
    blocks = sources.select("no", F.ceil(F.col("take") / block).cast("long").alias("n")).where("n > 0")
    owned = cut(running_sums(blocks, [], [F.col("no")], upto="n").select("no", (F.col("upto") - F.col("n")).alias("low"), F.col("upto").alias("high")))
    every = owned.agg(F.coalesce(F.max("high"), F.lit(0)).cast("long").alias("slots"))
    chunks = owned.select("*", F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(CHUNK))).alias("first")).repartition("no", "first")
    y = chunks.select("no", "low", "high", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("high")) - 1)).alias("y")).crossJoin(F.broadcast(every))
    return y.select("no", earlier(F.col("y"), F.col("low"), F.col("high")).alias("rank"), earlier(F.col("y"), F.lit(0).cast("long"), F.col("slots")).alias("slot"))


def laid_out(sizes: DataFrame, sources: DataFrame, seed: str = "mix") -> DataFrame:
    """``(doc_id, size, no, source_size, target, take, start)``: where a document of some words starts in its source's shuffled stream."""
    apart = sources.repartition(F.xxhash64("no"))  # dealt by another key: a large source's rows can be split in the join
    known = sizes.where("size > 0").join(apart, sizes["source"].eqNullSafe(apart["source"])).select("doc_id", "size", "no", "source_size", "target", "take")
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), F.col("doc_id"), F.col("size")]
    return running_sums(known, ["no"], order, upto="size").select("doc_id", "size", "no", "source_size", "target", "take", (F.col("upto") - F.col("size")).alias("start"))


def mixed_blocks(laid: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, no, rank, doc_id, size, source_size, target, start, first_word, words)``: the parts of documents that each slot takes.

    A document meets one block for every ``block`` of its words and at most one more, once for every time that its source's
    stream is gone through; blocks meet slots by source and number, a key that no source fills alone.
    """
    rounds = F.sequence(F.lit(0).cast("long"), _div(F.greatest(F.col("take") - 1, F.lit(0)), F.col("source_size")))
    turns = laid.withColumn("turn", F.explode(rounds)).withColumn("at", F.col("start") + F.col("turn") * F.col("source_size")).where("at < take")
    turns = turns.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("take")))
    parts = turns.withColumn("rank", F.explode(F.sequence(_div(F.col("at"), block), _div(F.col("end") - 1, block))))
    first = F.greatest(F.col("at"), F.col("rank") * block)
    parts = parts.withColumn("first_word", first - F.col("at")).withColumn("words", F.least(F.col("end"), (F.col("rank") + 1) * block) - first)
    slots = schedule(sources, block).hint("merge")  # written out from few rows: its size is taken for small, so it must not be broadcast
    return parts.join(slots, ["no", "rank"]).select("slot", "no", "rank", "doc_id", "size", "source_size", "target", "start", "first_word", "words")


def planned(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The targets with ``take``, the nearest whole number of words to each."""
    return cut(targets(sizes.select("source", "size"), weights, share, most).withColumn("take", F.floor(F.col("target") + 0.5).cast("long")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix of ``docs(doc_id, text, source)`` in order of ``slot``: which words of which document stand in each slot."""
    sizes = sized(docs)
    sources = planned(sizes, weights, share, most)
    return mixed_blocks(cut(laid_out(sizes, sources)), sources, block)


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row: the words that the mix takes of it, repeats counted."""
    sizes = sized(docs)
    sources = planned(sizes, weights, share, most)
    laid = cut(laid_out(sizes, sources))
    parts = mixed_blocks(laid, sources, block).select("no", "start", "doc_id", "size", "source_size", "target", "words")
    whole = parts.union(laid.select("no", "start", "doc_id", "size", "source_size", "target", F.lit(0).cast("long")))
    some = whole.groupBy("no", "start", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    apart = sources.repartition(F.xxhash64("no"))
    none = sizes.where("size = 0").join(apart, sizes["source"].eqNullSafe(apart["source"])).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.select("doc_id", "size", "source_size", "target", "taken").union(none)


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return taken(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM each),
fill AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(w) OVER o - w AS ws, sum(source_size) OVER () * 1.5::DOUBLE AS goal, sum(w) OVER () AS all_w FROM w
  WINDOW o AS (ORDER BY cap / w, no ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT arg_min((goal - caps) / (all_w - ws), (cap / w, no)) AS level FROM fill WHERE (goal - caps) / (all_w - ws) <= cap / w),
t AS (SELECT source, no, source_size, least(cap, coalesce(level * w, cap)) AS target FROM fill CROSS JOIN lv),
s AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
  (sum(d.size) OVER (PARTITION BY t.no ORDER BY md5(concat_ws(':', 'mix', d.doc_id::VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, take) - start) + greatest(0, least(start + size + source_size, take) - start - source_size))::BIGINT AS taken FROM s
"""
