"""Phrase collocations by suffix sorting: truncated suffixes, counted by one stack over sorted rows.

Texts are split into pieces and words. Every place gives the words from there on, four at most and none past its piece: a
truncated suffix. Suffixes are summed where they are made, dealt out by language and first word, sorted backward, and one
stack of open prefixes counts all phrases at once: a phrase is done when a suffix comes that doesn't begin with it.

A phrase of ``least`` places has no rarer word, so suffixes end before the first rare word. Single words are counted first,
exactly; a bitmap over hashes of the frequent ones goes to the tasks, of a size that follows their number up to a stated
bound. A rare word that meets a set bit stays and is counted: the bitmap saves work and decides nothing.

A first word that holds more than one in ``HOT_SHARE`` of all words is hot, so there are no more hot words than that. Its
suffixes are dealt out by the words up to the first that is not hot, or all of them. Phrases of hot words alone, shorter than
four, are then counted in parts, which are added up by phrase.

Nulls and empty texts have no words; a null language is ``und``; repeated rows are documents of their own; a text of any
length is worked on in runs. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import portions
from lattica.session import cut, table

LONGEST = 4
LEAST = 30
TOP = 2000
HOT_SHARE = 2048
#: Bytes of text that are worked on at once.
RUN_BYTES = 8 << 20
#: Bits of the bitmap of frequent words: sixteen a word, between these bounds (32 MB at most).
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28

_BREAK = b"\xff"  # a byte that no text in UTF-8 has
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_NEXT = re.compile(rb"(?: *[^ ]+){0,%d}" % (LONGEST - 1))


def token_runs(texts: list[bytes | None], run_bytes: int = RUN_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """Words in order with breaks between pieces, and how many of them are the run's own.

    Short texts share a run. A long one is cut between words; the words after its cut that a suffix may reach are there, but
    belong to the next run.
    """
    for start, stop in portions([len(t) if t else 0 for t in texts], run_bytes):
        whole = b"\n".join(t for t in texts[start:stop] if t).translate(_PLAIN).replace(b"\n", b" " + _BREAK + b" ")
        at = 0
        while at < len(whole):
            end = min(at + 2 * run_bytes, len(whole))
            if end < len(whole):
                found = whole.find(b" ", end)
                end = len(whole) if found < 0 else found
            own = whole[at:end].split()
            after = _NEXT.match(whole, end).group().split() if end < len(whole) else []
            yield own + after, len(own)
            at = end


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    lang = batch.column("lang").to_pylist()
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    for name in sorted(set(lang)):
        yield name, [t for t, own in zip(texts, lang) if own == name]


def _of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _dictionary(tokens: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    d = pa.array(tokens, pa.binary()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def count_words(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)`` for every word, summed in the tasks first; words are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for tokens, own in token_runs(texts):
                    ids, words = _dictionary(tokens[:own])
                    if len(words):
                        keep = pc.not_equal(words, pa.scalar(_BREAK, pa.binary()))
                        f = pa.array(np.bincount(ids, minlength=len(words)))
                        rows = pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words, f], ["lang", "word", "f"]).filter(keep)
                        yield rows

    parts = _of(docs).mapInArrow(run, "lang string, word binary, f long")
    return parts.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _spot(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang.cast("binary"), F.lit(b"\xff"), word))


def frequent_bits(frequent: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap, as bytes, over hashes of ``frequent(lang, word)``, and its number of bits; its size has a bound."""
    n = frequent.count()
    bits = FEWEST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    at = F.pmod(_spot(F.col("lang"), F.col("word")), F.lit(bits)) + 1  # buckets of positions start at 1
    rows = frequent.select(at.alias("p")).groupBy(F.call_function("bitmap_bucket_number", F.col("p")).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias("b"))
    out = np.zeros(bits // 8 + 8192, dtype=np.uint8)
    for r in rows.toLocalIterator():  # a row for every 32,768 bits
        own = np.frombuffer(bytes(r["b"]), dtype=np.uint8)
        start = (r["bucket"] - 1) * 4096
        out[start : start + len(own)] = own
    return out, bits


def _known(bitmap: np.ndarray, bits: int, lang: bytes, words: list[bytes]) -> np.ndarray:
    head = zlib.crc32(lang + b"\xff")
    p = np.fromiter((zlib.crc32(w, head) for w in words), dtype=np.int64, count=len(words)) % bits
    return (bitmap[p >> 3] >> (p & 7)) & 1 == 1


def suffixes(docs: DataFrame, frequent: DataFrame, hot: set[tuple[str, bytes]]) -> DataFrame:
    """``(deal, lang, suffix, c)``: suffixes of two to four words, each ended by a tab, with their counts in one run.

    ``deal`` is a hash of the words by which a suffix is dealt out.
    """
    bitmap, bits = frequent_bits(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, bits, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits, hot = shared.value
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for tokens, own in token_runs(texts):
                    ids, words = _dictionary(tokens)
                    names = words.to_pylist()
                    good = _known(bitmap, bits, lang.encode(), names)
                    good &= np.array([w != _BREAK for w in names], dtype=bool)
                    rows = _suffix_rows(ids, own, good, np.array([(lang, w) in hot for w in names], dtype=bool), names)
                    if rows is not None:
                        parts, deal, c = rows
                        tab = pa.scalar(b"\t", pa.binary())
                        text = pc.binary_join_element_wise(*[words.take(pa.array(np.where(p < 0, 0, p), mask=p < 0)) for p in parts], pa.array([b""] * len(c), pa.binary()), tab, null_handling="skip")
                        yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array([lang] * len(c)), text, pa.array(c)], ["deal", "lang", "suffix", "c"])

    return _of(docs).mapInArrow(run, "deal long, lang string, suffix binary, c long")


def _suffix_rows(ids: np.ndarray, own: int, good: np.ndarray, hot: np.ndarray, names: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """Word ids of the distinct suffixes of two words or more (-1: none), the hash each is dealt out by, and their counts."""
    wide = np.concatenate([np.where(good[ids], ids, -1), np.full(LONGEST, -1)]) if len(ids) else ids
    first = np.flatnonzero((wide[:own] >= 0) & (wide[1 : own + 1] >= 0))
    if not len(first):
        return None
    parts = [wide[first], wide[first + 1]]
    for k in range(2, LONGEST):
        parts.append(np.where(parts[-1] >= 0, wide[first + k], -1))
    code = parts[0]
    for p in parts[1:]:  # pairs of numbers become one number below their count, so that none overflows
        _, code = np.unique(code * (len(names) + 1) + p + 1, return_inverse=True)
    _, at, c = np.unique(code, return_index=True, return_counts=True)
    parts = [p[at] for p in parts]
    mark = np.array([zlib.crc32(w) for w in names], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    deal, more = np.zeros(len(at), dtype=np.uint64), np.ones(len(at), dtype=bool)
    for p in parts:
        here = more & (p >= 0)
        deal = np.where(here, (deal ^ mark[p]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1), deal)
        more = here & hot[p]
    return parts, deal.view(np.int64), c.astype(np.int64)


class PrefixStack:
    """Counts of the open phrases of one language, as its suffixes come sorted backward, a batch at a time.

    ``words[k]`` and ``sums[k]`` are the open phrase of k + 1 words and its count so far. Within a batch a phrase is a run of
    rows that begin alike, so what the stack would push and pop is found for all rows of a depth at once.
    """

    def __init__(self, hot: set[bytes], least: int):
        self.hot, self.least = hot, least
        self.words: list[bytes] = []
        self.sums: list[int] = []

    def closed(self, words: list[bytes], n: int) -> bool:
        """Whether a phrase that is done goes out: frequent, or to be added up with what others counted."""
        return len(words) > 1 and (n >= self.least or len(words) < LONGEST and all(w in self.hot for w in words))

    def push(self, suffixes: pa.Array, c: np.ndarray) -> list[tuple[bytes, int]]:
        """Phrases that the rows close, with their counts."""
        lists = pc.split_pattern(suffixes, b"\t")
        offsets = lists.offsets.to_numpy()
        flat = pc.cast(lists.values, pa.binary()).dictionary_encode()
        ids, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        size = np.diff(offsets) - 1  # the last word of each is empty
        offsets = offsets[:-1]
        hot = np.array([w in self.hot for w in names.to_pylist()], dtype=bool)
        out: list[tuple[bytes, int]] = []
        same = np.ones(len(size), dtype=bool)  # begins like the row before, so far
        same[0] = False
        warm = np.ones(len(size), dtype=bool)  # all words so far are hot
        first = [names[ids[offsets[0] + k]].as_py() for k in range(size[0])]
        kept = 0
        while kept < min(len(first), len(self.words)) and first[kept] == self.words[kept]:
            kept += 1
        words, sums = self.words, self.sums
        for k in range(kept, len(words)):
            if self.closed(words[: k + 1], sums[k]):
                out.append((b" ".join(words[: k + 1]), sums[k]))
        last = [names[ids[offsets[-1] + k]].as_py() for k in range(size[-1])]
        new_sums = []
        for k in range(LONGEST):
            deep = np.flatnonzero(size > k)
            if not len(deep):
                break
            own = np.full(len(size), -1, dtype=np.int64)
            own[deep] = ids[offsets[deep] + k]
            same[1:] &= own[1:] == own[:-1]
            warm &= (own >= 0) & hot[own]
            start = deep[~same[deep]]  # rows that open a phrase of this depth; rows between that are not so deep end one
            if not len(start):
                start = deep[:1]
            n = np.add.reduceat(np.where(size > k, c, 0), start)
            if kept > k:
                n[0] += sums[k]
            still = len(last) > k
            if still:
                new_sums.append(int(n[-1]))
            done, total = (start[:-1], n[:-1]) if still else (start, n)
            if k:
                go = total >= self.least
                if k + 1 < LONGEST:
                    go |= warm[done]
                for i, a in zip(done[go], total[go]):
                    out.append((b" ".join(names[x].as_py() for x in ids[offsets[i] : offsets[i] + k + 1]), int(a)))
        self.words, self.sums = last, new_sums
        return out

    def close(self) -> list[tuple[bytes, int]]:
        return [(b" ".join(self.words[: k + 1]), n) for k, n in enumerate(self.sums) if self.closed(self.words[: k + 1], n)]


def count_phrases(rows: DataFrame, hot: set[tuple[str, bytes]], least: int) -> DataFrame:
    """``(lang, phrase, a)``: phrases of two words and more of at least ``least`` places, words joined by a space.

    Rows come sorted backward, so a phrase's suffixes stand together, the longer before the shorter, and each language has
    a stack of its own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        stacks: dict[str, PrefixStack] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang").dictionary_encode()
            at, c = lang.indices.to_numpy(zero_copy_only=False), batch.column("c").to_numpy()
            out = []
            for i, name in enumerate(lang.dictionary.to_pylist()):
                if name not in stacks:
                    stacks[name] = PrefixStack({w for own, w in hot if own == name}, least)
                own = np.flatnonzero(at == i)
                out += [(name, p, n) for p, n in stacks[name].push(batch.column("suffix").take(pa.array(own)), c[own])]
            yield _phrases(out)
        yield _phrases([(name, p, n) for name, s in stacks.items() for p, n in s.close()])

    dealt = rows.repartition("lang", "deal").sortWithinPartitions(F.desc("suffix")).select("lang", "suffix", "c")
    parts = dealt.mapInArrow(run, "lang string, phrase string, a long")
    return parts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _phrases(out: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
    lang, phrase, a = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(a, pa.int64())], ["lang", "phrase", "a"])


def _whole(c: Column) -> Column:
    return c.cast("decimal(28,0)")


def scored(phrases: DataFrame, words: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """``(lang, phrase, a, l, r, score)``: every phrase at its cut of lowest score, the earliest of equal ones.

    Both parts of every cut are looked up in the table of all counts, which is dealt out apart from the cuts, so that a part
    that stands in many phrases can be split.
    """
    known = cut(phrases.select("lang", "phrase", "a").union(words.select("lang", F.col("word").cast("string").alias("phrase"), F.col("f").alias("a"))))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.call_function("div", _whole(F.col("a")) * F.lit(scale), _whole(F.col("l")) + _whole(F.col("r")))
    lowest = met.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def within_longer(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, longer)``: the count of the most frequent longer phrase that holds the phrase's words side by side."""
    w = F.split("phrase", " ")
    size = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inner = phrases.withColumn("w", w).where(size > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    return inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def best_of_each_lang(found: DataFrame, top: int, ways: int = 64) -> DataFrame:
    """The first ``top`` rows of each language by score, count and phrase, with their ``rank``; each of ``ways`` parts of a language is cut to ``top`` first."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = found.withColumn("way", F.pmod(F.xxhash64("phrase"), F.lit(ways)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "way").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("way")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's strongest phrases of ``docs(text, lang)``.

    A phrase goes if a longer one that holds it has 80 in 100 of its places or more.
    """
    counted = cut(count_words(docs))
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = cut(counted.where(F.col("f") >= least))
    everything = total.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = {(r["lang"], bytes(r["word"])) for r in words.where(F.col("f") * HOT_SHARE > everything).select("lang", "word").collect()}  # fewer than HOT_SHARE
    phrases = cut(count_phrases(suffixes(docs, words, hot), hot, least))
    met = scored(phrases, words).join(within_longer(phrases), ["lang", "phrase"], "left")
    kept = met.where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * 80))
    best = best_of_each_lang(kept.drop("longer"), top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = rf"""
WITH p AS (SELECT lang, p_id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM
  (SELECT lang, piece, row_number() OVER () AS p_id FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k AS size, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM t, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= {LEAST}),
k AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, l.a AS l, r.a AS r, (2000000::HUGEINT * k.a // (l.a + r.a))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(list_slice(k.w, 1, k.k), ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(list_slice(k.w, k.k + 1, k.size), ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.size > x.size AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100::HUGEINT * y.a >= 80::HUGEINT * x.a)),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= {TOP}
"""
