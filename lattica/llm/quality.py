"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features describe the line (length, share of capitals, digits, symbols and
accented letters, distinct and repeated words, whether the line came before) and the lines before and after it. The
chain's forward-backward marginals, weighted by line length, add up to the document's quality, which a logistic curve
turns into a probability.

Fitted on at most ``max_rows`` labelled rows outside the held-out fold (documented bounds: 6,000, and 400,000 lines), each line carrying its
document's label; two thirds fit the field, the rest the curve (all of them, where the rest has fewer than five rows of a class). Every document is scored whole.

Defined results: a null or empty text is one empty line; a null doc_id is scored and counts as held out; repeated rows
are scored one by one; extra columns are ignored; without labels every score is 0.5 or above the cut-off.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import both_classes, fit_logistic, held_out, map_texts, portions, sigmoid, training_sample
from lattica.session import cut, table

PREDICT_AT = 0.3
LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER, BREAK = range(8)


def _classes() -> np.ndarray:
    out = np.full(0x251, OTHER, dtype=np.uint8)
    for cp in range(0x250):
        c = chr(cp)
        out[cp] = LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else SPACE if c.isspace() else STOP if c in ".,;:'\"-()?" else SYMBOL
    out[10] = BREAK
    return out


CLASSES = _classes()
OWN = 14


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' lengths, and the number of lines of each text."""
    lines: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    words = []
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        counts[i] = len(own)
        seen: set[str] = set()
        before = None
        for line in own:
            w = line.split()
            n = len(w)
            again = bool(n) and line in seen
            if n:
                seen.add(line)
            words.append((n, len(set(w)), sum(map(operator.eq, w, w[1:])) if n > 1 else 0, again, line == before and n > 0))
            before = line
        lines.extend(own)
    cp = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = CLASSES[np.minimum(cp, 0x250)]
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    owner = np.repeat(np.arange(len(lines), dtype=np.int64), length + 1)[: len(cp)]
    tally = np.bincount(owner * 8 + cls, minlength=8 * len(lines)).reshape(-1, 8)[:, :7].astype(np.float32)
    w = np.array(words, dtype=np.float32).reshape(-1, 5)
    chars, n_words = np.maximum(length, 1).astype(np.float32), np.maximum(w[:, 0], 1)
    letters = np.maximum(tally[:, LOWER] + tally[:, UPPER], 1)
    own = np.column_stack(
        [
            np.log1p(length) / 5, np.log1p(w[:, 0]) / 4, np.minimum(chars / n_words, 20) / 10, tally[:, UPPER] / letters, tally[:, DIGIT] / chars, tally[:, SYMBOL] / chars * 5,
            tally[:, STOP] / chars * 5, tally[:, OTHER] / chars, w[:, 1] / n_words, w[:, 2] / n_words, w[:, 3], w[:, 4], np.log(w[:, 1] + 1) / np.log(n_words + 1), length == 0,
        ]
    ).astype(np.float32)
    first = np.zeros(len(lines), dtype=bool)
    first[np.cumsum(counts)[:-1]] = True
    first[0] = True
    last = np.roll(first, -1)
    prev, nxt = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    prev[first], nxt[last] = 0, 0
    squares = own[:, [2, 3, 5, 8, 9, 12]] ** 2
    short = own[:, [8, 9, 12]] * (w[:, 0] < 12)[:, None]
    return np.column_stack([np.ones(len(lines)), own, squares, short, prev, nxt, first, last]).astype(np.float32), length, counts


@dataclass
class LineField:
    """Emission weights of good against bad, and the transition scores [bad, good] x [bad, good]."""

    emission: np.ndarray
    transition: np.ndarray
    curve: np.ndarray


def marginals(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line by forward-backward over all chains at once, and the expected transitions into lines, summed by the lines' ``weight``."""
    n = len(emission)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max()) if len(counts) else 0
    alive = np.searchsorted(-counts[order], -np.arange(longest), side="left")
    e = np.stack([np.zeros(n), emission], axis=1)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(longest):
        rows = start[order[: alive[t]]] + t
        if t == 0:
            a = e[rows]
        else:
            p = fwd[rows - 1]
            a = e[rows] + np.logaddexp(p[:, :1] + transition[0], p[:, 1:] + transition[1])
        fwd[rows] = a - np.logaddexp(a[:, :1], a[:, 1:])
    for t in range(longest - 2, -1, -1):
        rows = start[order[: alive[t + 1]]] + t
        q = bwd[rows + 1] + e[rows + 1]
        b = np.logaddexp(transition[:, 0] + q[:, :1], transition[:, 1] + q[:, 1:])
        bwd[rows] = b - b.max(axis=1, keepdims=True)
    good = sigmoid((fwd + bwd)[:, 1] - (fwd + bwd)[:, 0])
    inner = np.ones(n, dtype=bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pair = fwd[at - 1][:, :, None] + transition[None] + (e + bwd)[at][:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)) if len(at) else np.zeros((0, 2, 2))
    share = np.ones(len(at)) if weight is None else weight[at]
    return good, (pair * (share / pair.sum(axis=(1, 2)))[:, None, None]).sum(axis=0) if len(at) else np.zeros((2, 2))


def fit_field(x: np.ndarray, counts: np.ndarray, y: np.ndarray, l2: float = 2e-3, steps: int = 250) -> LineField:
    """Maximum likelihood with a ridge, by Adam; every document weighs the same, and classes are balanced half-way."""
    label = np.repeat(y, counts).astype(float)
    share = max(1e-3, min(1 - 1e-3, y.mean())) if len(y) else 0.5
    by_doc = np.where(y == 1, 1 / share, 1 / (1 - share)) ** 0.5 / counts
    weight = np.repeat(by_doc, counts)
    weight = weight / max(weight.sum(), 1e-9)
    same = np.array([(by_doc * (counts - 1))[y == 0].sum(), (by_doc * (counts - 1))[y == 1].sum()]) / max((by_doc * counts).sum(), 1e-9)
    w, tr = np.zeros(x.shape[1]), np.eye(2) * 0.5
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        good, pairs = marginals(x @ w, counts, tr, weight)
        grad_w = x.T @ (weight * (good - label)) + l2 * w
        grad_t = pairs - np.diag(same) + 0.05 * tr
        g = np.concatenate([grad_w, grad_t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-4]
        tr -= move[-4:].reshape(2, 2)
    return LineField(w, tr, np.zeros(3))


def document_quality(texts: list[str | None], field: LineField) -> np.ndarray:
    """Length-weighted mean of the lines' marginals and the weighted share of lines that are clearly bad, by document."""
    return np.concatenate([_portion_quality(texts[a:b], field) for a, b in portions([len(t) if t else 0 for t in texts])]) if len(texts) else np.zeros((0, 2))


def _portion_quality(texts: list[str | None], field: LineField) -> np.ndarray:
    x, length, counts = line_features(texts)
    good, _ = marginals(x @ field.emission, counts, field.transition)
    weight = length + 1.0
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    total = np.add.reduceat(weight, start)
    mean = np.add.reduceat(weight * good, start) / total
    clear = np.add.reduceat(weight * np.clip(np.log(np.clip(good, 1e-6, 1 - 1e-6) / np.clip(1 - good, 1e-6, 1)), -8, 8), start) / total
    return np.column_stack([mean, clear])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_lines: int = 400_000) -> LineField:
    """The field and its curve from a bounded sample; only line features and marginals come to the driver.

    The sample is at most ``max_rows`` labelled rows, and, in the order of a hash of their ids, so many of them as have
    ``max_lines`` lines together. Of several texts under one doc_id the smallest is learnt from.
    """
    sample = training_sample(labels, "quality", max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = rows.select("text", "y", F.xxhash64("doc_id").alias("h"), (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", "")) + 1).alias("n"))
    rows = cut(rows.withColumn("part", F.pmod("h", F.lit(3))))
    width = len(line_features([""])[0][0])
    known = rows.where("part > 0").select("h", "n").toPandas().sort_values("h")
    within = known[known["n"].cumsum() <= max(max_lines, known["n"].iloc[0] if len(known) else 0)]
    last = int(within["h"].max()) if len(within) else 0

    def features(batches):
        for batch in batches:
            texts, y = batch["text"].tolist(), batch["y"].to_numpy()
            for start, stop in portions([len(t) if t else 0 for t in texts]):
                x, _, counts = line_features(texts[start:stop])
                at = np.concatenate([[0], np.cumsum(counts)])
                yield pd.DataFrame({"y": y[start:stop], "n": counts, "x": [x[a:b].astype("<f4").tobytes() for a, b in zip(at, at[1:])]})

    found = rows.where((F.col("part") > 0) & (F.col("h") <= last)).orderBy("h").select("text", "y").mapInPandas(features, "y int, n long, x binary").toPandas()
    if found.empty or found["y"].nunique() < 2:
        return LineField(np.zeros(width), np.zeros((2, 2)), np.zeros(3))
    x = np.concatenate([np.frombuffer(b, dtype="<f4").reshape(-1, width) for b in found["x"]])
    field = fit_field(x, found["n"].to_numpy(), found["y"].to_numpy())

    def qualities(batches):
        for batch in batches:
            q = document_quality(batch["text"].tolist(), field)
            yield pd.DataFrame({"y": batch["y"].to_numpy(), "mean": q[:, 0], "clear": q[:, 1]})

    apart = rows.where("part = 0")
    calibrating = apart if both_classes(apart) else rows  # too few rows for a part of their own: all of them, which hold both classes
    rest = calibrating.mapInPandas(qualities, "y int, mean double, clear double").toPandas()
    field.curve = fit_logistic(rest[["mean", "clear"]].to_numpy(), rest["y"].to_numpy(), l2=1e-4)
    return field


def _probability(texts: list[str | None], field: LineField) -> tuple[np.ndarray, np.ndarray]:
    q = document_quality(texts, field)
    return sigmoid(field.curve[0] + q @ field.curve[1:]), q[:, 0]


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """``(doc_id, score, line_quality)`` for every row."""

    def work(texts):
        p, q = _probability(texts, field)
        return [pa.array(p), pa.array(q)]

    return map_texts(docs, ["doc_id"], lambda: work, "doc_id long, score double, line_quality double")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that score under ``PREDICT_AT``; scored in the same pass, with no join back."""
    field = fit(docs, labels, **options)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(_probability(text.tolist(), field)[0] if len(text) else [], dtype=float)

    return docs.where(of(F.col("text")) >= PREDICT_AT)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "line_quality")
