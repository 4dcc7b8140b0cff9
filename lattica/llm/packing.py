"""Best-fit packing of tokenized documents into sequences by exact-complement hashing.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers whatever the input: from the
longest length down, single, pair and triple sums of the lengths still available are looked up for the exact gap and
consumed as often as the counts allow; what is left is packed best-fit. The plan is a list of runs ``(length, ranks,
sequences, offset)``; pieces are numbered within their length by the task that makes them and get their rank from the
counts of the tasks before, so that one length may hold any share of the rows; they find their run by a range condition.

Defined results: a null text is an empty one, whose document is the end id alone; rows with a null doc_id are packed
like others; repeated rows are documents of their own; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import ByteMemo, portions
from lattica.session import cut, table

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, inside long"
PLAN = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, offset_from long"
MEMO_BYTES, PORTION = 96 << 20, 1 << 22


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word encoded once while it is remembered.

    The tokenizer's first step parts words at white space and into runs of letters, single digits and runs of signs,
    and no merge crosses them, so the ids of a text are those of its words in turn. Words not yet known go to the
    tokenizer together, parted by a space; the end-of-word mark in the vocabulary says where each one's ids end.
    """

    #: The tokenizer's own pattern of words.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: White space to ``str.split`` but signs to the tokenizer, and its special tokens.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "oftext|>")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for words that are in normal form and parted already
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words = regex.compile(self.WORDS)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.memo = ByteMemo(MEMO_BYTES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word_ids(self, words: set[str]) -> dict[str, bytes]:
        known, fresh = self.memo.split(words)
        for at in range(0, len(fresh), 2_000):
            own = fresh[at : at + 2_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stop) == len(own):
                b, stop = ids.tobytes(), stop.tolist()
                found = {w: b[s:e] for w, s, e in zip(own, [0, *stop], stop)}
            else:
                found = {w: self.whole(w) for w in own}
            self.memo.keep(found, 4 * len(ids))
            known |= found
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        from unicodedata import is_normalized, normalize

        odd = [any(x in t for x in self.ODD) for t in texts]
        low = ["" if o else t if is_normalized("NFC", t) else normalize("NFC", t) for t, o in zip(texts, odd)]
        split = pc.utf8_split_whitespace(pa.array([t.replace("Σ", "σ").lower() for t in low], pa.string()))  # letter by letter, so no final sigma
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary.to_pylist()
        parted = {c: self.words.findall(c) for c in chunks if not c.isalpha()}
        ids = self.word_ids({c for c in chunks if c not in parted}.union(*parted.values()))
        parts = [b"".join([ids[w] for w in parted[c]]) if c in parted else ids[c] for c in chunks]
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        start, at = np.cumsum(size) - size, numbered.indices.to_numpy()
        end = np.concatenate([[0], np.cumsum(size[at])])  # of each chunk of the texts: where its ids end
        take = np.repeat(start[at] - end[:-1], size[at]) + np.arange(end[-1])
        flat = np.frombuffer(b"".join(parts), dtype="<u4")[take].tobytes()
        cuts = (end[split.offsets.to_numpy()] * 4).tolist()
        return [self.whole(t) if o else flat[x:y] for t, o, x, y in zip(texts, odd, cuts, cuts[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].memo.limit = memo_bytes
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """The documents' ids, ended by ``end_id`` and cut where longer than ``capacity``: one row a piece.

    ``part`` is the task that made the piece and ``inside`` its number, from 0, among that task's pieces of its length.
    """
    path = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, memo_bytes), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for first, stop in portions(pc.binary_length(batch.column("text")).to_pylist(), PORTION):
                own = batch.slice(first, stop - first)
                row, rows = [], []
                for i, b in enumerate(enc.encode([t or "" for t in own.column("text").to_pylist()])):
                    b += end
                    for piece, at in enumerate(range(0, len(b), 4 * capacity)):
                        ids = b[at : at + 4 * capacity]
                        n = len(ids) // 4
                        row.append(i)
                        rows.append((piece, at // 4, n, zlib.crc32(ids), part, seen[n]))
                        seen[n] += 1
                doc = own.column("doc_id").take(pa.array(row, pa.int64()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([doc, *columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "inside"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _take(free: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often the lengths can be taken together."""
    return min(int(free[n]) // lengths.count(n) for n in set(lengths))


def _complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, the longest first."""
    if free[gap] > 0:
        return (gap,)
    have = free > 0

    def pair(total: int, skip: int = 0):
        low = np.arange(1, total // 2 + 1)
        hits = low[have[low] & have[total - low]]
        for a in hits[:3]:
            found = (int(total - a), int(a))
            if all(int(free[n]) >= (*found, skip).count(n) for n in set(found)):
                return found
        return None

    if gap >= 2 and (found := pair(gap)):
        return found
    if gap >= 3:
        size = 1 << (2 * gap - 1).bit_length()
        pairs = np.fft.irfft(np.fft.rfft(have[:gap].astype(float), size) ** 2, size) > 0.5  # which sums of two lengths exist
        for d in np.flatnonzero(have[1 : gap - 1] & pairs[gap - 1 : 1 : -1])[::-1] + 1:
            if (found := pair(gap - int(d), int(d))):
                return (int(d), *found)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLAN`` for pieces of the given lengths; the work depends on the number of lengths, not of pieces."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        free[n] = c
    groups: list[tuple[list[tuple[int, int]], int]] = []  # ([(length, how many)], sequences)
    if free[capacity]:
        groups.append(([(capacity, 1)], int(free[capacity])))
        free[capacity] = 0
    for n in range(capacity - 1, 0, -1):
        while free[n] > 0:
            free[n] -= 1
            found = _complement(free, capacity - n)
            free[n] += 1
            if not found:
                break
            times = _take(free, (n, *found))
            for m in (n, *found):
                free[m] -= times
            groups.append(([(m, 1) for m in (n, *found)], times))
    open_groups: dict[int, list[tuple[tuple, int]]] = {}
    gaps: list[int] = []

    def put(gap, content, times):
        if gap not in open_groups:
            open_groups[gap] = []
            insort(gaps, gap)
        open_groups[gap].append((content, times))

    for n in range(capacity - 1, 0, -1):
        left = int(free[n])
        while left:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if left >= per:
                    put(capacity - per * n, ((n, per),), left // per)
                    left %= per
                if left:
                    put(capacity - left * n, ((n, left),), 1)
                    left = 0
                continue
            gap = gaps[at]
            content, times = open_groups[gap].pop()
            if not open_groups[gap]:
                del open_groups[gap]
                gaps.pop(at)
            per = min(gap // n, left)
            used = min(times, left // per)
            if used < times:
                put(gap, content, times - used)
            put(gap - per * n, (*content, (n, per)), used)
            left -= used * per
    groups += [(list(content), times) for held in open_groups.values() for content, times in held]
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for content, times in groups:
        offset = 0
        for n, per in content:
            rows.append((n, rank[n], rank[n] + per * times, per, sequence, offset))
            rank[n] += per * times
            offset += n * per
        sequence += times
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length: the pieces of that length in earlier tasks, and ``inside``. No raw rows are sorted or gathered."""
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(sizes, ["length", "part"]).withColumn("rank", F.col("base") + F.col("inside")).drop("part", "inside", "base")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """One row a piece with its sequence and the offset in it; a worker remembers the ids of words in twice ``memo_bytes`` at most."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, path, capacity, end_id, memo_bytes))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(counts, capacity), PLAN).withColumnRenamed("length", "_length")
    at = F.col("rank") - F.col("rank_from")
    met = ranked(pieces).join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + F.pmod(at, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of every document."""
    return pack(table(spark, sf_dir, "documents"))
