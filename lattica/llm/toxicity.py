"""Toxic passages by maximum-scoring segment search, calibrated by extreme values.

Tokens are lower-cased words; a word's features are itself and its character n-grams (4 to 6, with marks at its ends),
so inflected forms share evidence. A run of more than 24 word characters (text without spaces, glued words) is cut into
tokens of 16 n-gram starts each, which cover it to its end; each n-gram lies in one of them. A feature's weight is its
log-odds between toxic and clean labelled documents under a Dirichlet prior whose shape is the feature's frequency over
the whole corpus; the lexicon is every feature of enough support and log-odds, however many. A token scores its heaviest
feature of the lexicon, any other token a small loss, and one linear scan finds all maximal scoring segments of a
document. The best segment's score is brought to Karlin-Altschul form, ``lambda * S - ln(K * n)``, with ``lambda`` from
the background score distribution and ``K`` from clean labelled documents; a logistic curve over it and the summed
excess of all significant segments gives the score.

Texts are read a portion at a time: character classes and token numbers are arrays, and one automaton over the lexicon
finds every feature in one pass, so the cost does not depend on how many different words there are.

Fitted on at most ``max_rows`` labelled rows outside the held-out fold (documented bound: 20,000); two thirds fit the
lexicon, the rest the calibration. Of several texts under one doc_id the smallest is learnt from. Corpus frequencies
cover every document.

Defined results: a null text is an empty one and scores as a document without segments; rows with a null doc_id are
scored and count as held out; repeated rows are scored one by one; extra columns are ignored; without labels of both
classes the score is under 0.5 for all. Where the third to calibrate on has fewer than five rows of a class, all rows serve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import both_classes, fit_logistic, held_out, map_texts, portions, sigmoid, training_sample
from lattica.session import cut, table

LONG, STEP = 24, 16
HELD = 200_000
WORD = re.compile(r"\w+")
_classes: dict[str, np.ndarray] = {}


def word_characters() -> np.ndarray:
    """For every code point whether ``\\w`` matches it."""
    if "word" not in _classes:
        _classes["word"] = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), dtype=bool, count=0x110000)
    return _classes["word"]


def word_features(word: str) -> set[str]:
    """The features of a lower-cased word, a space for each of its ends: the word itself up to ``LONG`` letters, and its n-grams."""
    x = f" {word} "
    found = {x[i : i + n] for n in (4, 5, 6) for i in range(len(x) - n + 1)}
    if len(word) <= LONG:
        found.add(x)
    return found


@dataclass
class Tokens:
    """Texts as one string of lower-cased words parted by single spaces, and where each token lies."""

    text: str
    first: np.ndarray  # of each character, or the one after a space: its word
    start: np.ndarray  # of each word: place of its first character
    base: np.ndarray  # of each word: number of its first token
    pieces: np.ndarray  # of each word: how many tokens it is
    owner: np.ndarray  # of each word: its text
    n_texts: int

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        low = [(t or "").lower() for t in texts]
        cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = word_characters()[cp]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] = True
        at = np.flatnonzero(keep)
        inside = word[at]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        place = at[begins]
        own = np.where(inside, cp[at], 32).astype("<u4")
        if len(own) == 1:
            own = np.zeros(0, dtype="<u4")
        first = np.cumsum(np.concatenate([inside[1:] & ~inside[:-1], [False]])) - 1  # a space belongs to the word after it
        first = np.maximum(first, 0)
        ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
        length = ends - begins
        pieces = np.where(length > LONG, (length - 2) // STEP + 1, 1)
        base = np.concatenate([[0], np.cumsum(pieces)[:-1]]) if len(pieces) else pieces
        edges = np.cumsum([len(t) + 1 for t in low])
        owner = np.searchsorted(edges, place, side="left")
        return cls(own.tobytes().decode("utf-32-le", "surrogatepass"), first, begins, base, pieces, owner, len(texts))

    def counts(self) -> np.ndarray:
        """Number of tokens of each text."""
        return np.bincount(self.owner, weights=self.pieces, minlength=self.n_texts).astype(np.int64)

    def token_at(self, place: np.ndarray) -> np.ndarray:
        """The token in which an n-gram that starts at ``place`` lies."""
        w = self.first[place]
        return self.base[w] + np.where(self.pieces[w] > 1, (place - self.start[w] + 1) // STEP, 0)


class Lexicon:
    """Features as one automaton."""

    def __init__(self, features: list[str], weights: list[float] | None = None):
        import ahocorasick

        self.length = np.array([len(f) for f in features], dtype=np.int64)
        self.weight = np.array(weights if weights is not None else [1.0] * len(features))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, f in enumerate(features):
            self.automaton.add_word(f, i)
        self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of every feature in the text."""
        if not len(self.length) or not text:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = np.array(list(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        return found[:, 0] - self.length[found[:, 1]] + 1, found[:, 1]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    loss: float = -0.3
    lam: float = 1.0
    k: float = 1e-3
    curve: list[float] = field(default_factory=lambda: [-3.0, 0.0, 0.0])

    def significant(self, n_words: int) -> float:
        """The segment score that chance reaches in ``n_words`` words less than once in 20 documents."""
        return (math.log(self.k * max(n_words, 1)) - math.log(0.05)) / self.lam

    def lexicon(self) -> Lexicon:
        return Lexicon(list(self.weights), list(self.weights.values()))


def maximal_segments(at: list[int], gains: list[float], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of tokens that gain at ``at`` and lose ``loss`` elsewhere.

    Linear in the gains: a candidate stores the last candidate of a smaller total before it, so the search for the one
    to be extended follows stored links and passes over each candidate once.
    """
    first: list[int] = []
    end: list[int] = []
    before: list[float] = []
    after: list[float] = []
    smaller: list[int] = []  # the last candidate whose total before it is less than this one's
    total, last = 0.0, -1
    for i, gain in zip(at, gains):
        start, low = i, total + loss * (i - last - 1)
        total, last = low + gain, i
        j = len(first) - 1
        while j >= 0 and before[j] >= low:
            j = smaller[j]
        while j >= 0 and after[j] < total:
            start, low = first[j], before[j]
            link = smaller[j]
            del first[j:], end[j:], before[j:], after[j:], smaller[j:]
            j = link
        first.append(start)
        end.append(i + 1)
        before.append(low)
        after.append(total)
        smaller.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, end, before, after)]


def segments_of(texts: list[str | None], lexicon: Lexicon, loss: float) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Number of tokens of each text, and its maximal scoring segments in tokens."""
    tokens = Tokens.of(texts)
    counts = tokens.counts()
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    start, feature = lexicon.hits(tokens.text)
    if len(start):
        token = tokens.token_at(start)
        order = np.lexsort((lexicon.weight[feature], token))
        token, weight = token[order], lexicon.weight[feature[order]]
        top = np.append(token[1:] != token[:-1], True)  # the heaviest feature of each token
        token, weight = token[top], weight[top]
        edges = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.searchsorted(token, edges)
        for i in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[i], cuts[i + 1])
            out[i] = maximal_segments((token[own] - edges[i]).tolist(), weight[own].tolist(), loss)
    return counts, out


def evidence(n: int, scores: list[float], model: ToxicityModel) -> tuple[float, float]:
    """Extreme-value form of the best segment, and the log of the summed excess of all significant ones."""
    if not len(scores):
        return -8.0, 0.0
    base = math.log(model.k * max(n, 1))
    z = [model.lam * s - base for s in scores]
    floor = -math.log(0.05)
    return max(-8.0, min(max(z), 40.0)), math.log1p(sum(x - floor for x in z if x > floor))


def _labelled_counts(docs: DataFrame) -> DataFrame:
    """``(feature, y, n)``: labelled documents of each class that hold the feature; feature '' counts their distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {}
        for batch in batches:
            for y, text in zip(batch["y"].tolist(), batch["text"]):
                words = set(WORD.findall((text or "").lower()))
                own = counts.setdefault(y, Counter())
                own[""] += len(words)
                own.update(set().union(*map(word_features, words)))
                if len(own) > HELD:
                    yield pd.DataFrame({"feature": list(own), "y": y, "n": list(own.values())})
                    own.clear()
        for y, c in counts.items():
            yield pd.DataFrame({"feature": list(c), "y": y, "n": list(c.values())})

    return docs.select("text", "y").mapInPandas(run, "feature string, y int, n long").groupBy("feature", "y").agg(F.sum("n").alias("n"))


def corpus_counts(docs: DataFrame, features: list[str]) -> tuple[np.ndarray, int]:
    """How often each feature occurs in all documents, and how many tokens they have; a row a feature comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(features)
        n, total = np.zeros(len(features), dtype=np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions([len(t) if t else 0 for t in texts]):
                tokens = Tokens.of(texts[a:b])
                n += np.bincount(lexicon.hits(tokens.text)[1], minlength=len(features))
                total += int(tokens.pieces.sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], names=["i", "n"])

    found = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(features), dtype=np.int64)
    own = found[found["i"] >= 0]
    out[own["i"].to_numpy()] = own["n"].to_numpy()
    return out, int(found.loc[found["i"] < 0, "n"].sum())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_toxic: int = 5, prior: float = 2_000.0, min_log_odds: float = 4.0) -> ToxicityModel:
    """Learn lexicon, calibration and extreme-value terms. What comes to the driver are the markedly toxic features of at most ``max_rows`` documents."""
    sample = training_sample(labels, "toxic", max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = cut(rows.select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part")))
    first = rows.where("part > 0").groupBy("text").agg(F.max("y").alias("y"))
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    counts = cut(_labelled_counts(first).groupBy("feature").agg(n(1).alias("k"), n(0).alias("m")).where((F.col("k") >= min_toxic) | (F.col("feature") == "")))
    model = ToxicityModel()
    totals = counts.where("feature = ''").first()
    if totals is None:
        return model
    n_t, n_c = max(1, totals["k"]), max(1, totals["m"])
    prior = min(prior, 0.01 * (n_t + n_c))
    k, m, a = F.col("k"), F.col("m"), F.greatest(prior * (F.col("k") + F.col("m")) / (n_t + n_c), F.lit(0.01))
    odds = F.log((k + a) / (n_t + prior - k - a)) - F.log((m + a) / (n_c + prior - m - a))
    found = counts.where((F.col("feature") != "") & (odds >= min_log_odds - 1)).toPandas().sort_values("feature", ignore_index=True)
    if found.empty:
        return model
    everywhere, total = corpus_counts(docs, found["feature"].tolist())
    k, m = found["k"].to_numpy(float), found["m"].to_numpy(float)
    a = np.maximum(prior * everywhere / max(total, 1), 0.01)
    weight = np.log((k + a) / (n_t + prior - k - a)) - np.log((m + a) / (n_c + prior - m - a))
    good = weight >= min_log_odds
    model.weights = dict(zip(found["feature"][good], np.minimum(weight[good], 8.0).tolist()))
    _extreme_value_terms(model, dict(zip(found["feature"][good], (m[good] / n_c).tolist())))
    apart = rows.where("part = 0")
    held = cut(_segment_scores(apart if both_classes(apart) else rows, model))  # too few rows for a part of their own: all of them
    clean = held.where("y = 0").agg(F.sum("n"), F.sum(F.size("scores"))).first()
    floor = min(model.weights.values(), default=1.0)
    model.k = float(((clean[1] or 0) + 1) / (max(1, clean[0] or 0) * math.exp(-model.lam * floor)))
    shown = _evidence(held, model).toPandas()
    if shown["y"].nunique() < 2:
        return model  # one class only says nothing of the other: the curve that rejects no document stays
    model.curve = fit_logistic(shown[["best", "excess"]].to_numpy(), shown["y"].to_numpy()).tolist()
    return model


def _extreme_value_terms(model: ToxicityModel, share: dict[str, float]) -> None:
    """Solve ``sum p(s) exp(lambda s) = 1`` for the background distribution of word scores."""
    s = np.array([model.weights[f] for f in share])
    p = np.array([max(x, 1e-9) for x in share.values()])
    p = p / max(1.0, 2 * p.sum())
    rest = 1 - p.sum()

    def over(lam):
        return rest * math.exp(model.loss * lam) + float((p * np.exp(lam * s)).sum()) - 1

    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    model.lam = max(0.05, low)


def _segment_scores(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(y, n, scores)``: tokens and scores of all maximal segments of each row."""

    def make():
        lexicon = model.lexicon()

        def work(texts):
            counts, found = segments_of(texts, lexicon, model.loss)
            return [pa.array(counts), pa.array([[s for _, _, s in own] for own in found], pa.list_(pa.float64()))]

        return work

    return map_texts(rows, ["y"], make, "y int, n long, scores array<double>")


def _evidence(held: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [evidence(n, s, model) for n, s in zip(batch["n"], batch["scores"])]
            yield pd.DataFrame({"y": batch["y"], "best": [b for b, _ in both], "excess": [e for _, e in both]})

    return held.mapInPandas(run, "y int, best double, excess double")


def _probabilities(counts: np.ndarray, found: list[list[tuple[int, int, float]]], model: ToxicityModel) -> tuple[np.ndarray, list[float]]:
    b0, b1, b2 = model.curve
    both = [evidence(n, [s for _, _, s in own], model) for n, own in zip(counts.tolist(), found)]
    e = np.array(both, dtype=float).reshape(-1, 2)
    return sigmoid(b0 + b1 * e[:, 0] + b2 * e[:, 1]), e[:, 0].tolist()


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score, n_words, best, passages)`` for every row; passages are the significant segments, in tokens."""
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        lexicon = model.lexicon()

        def work(texts):
            counts, found = segments_of(texts, lexicon, model.loss)
            p, best = _probabilities(counts, found, model)
            shown = [[{"start": a, "end": b, "score": s} for a, b, s in own if s >= model.significant(n)] for n, own in zip(counts.tolist(), found)]
            return [pa.array(p), pa.array(counts), pa.array(best, pa.float64()), pa.array(shown, passage)]

        return work

    return map_texts(docs, ["doc_id"], make, "doc_id long, score double, n_words long, best double, passages array<struct<start:int,end:int,score:double>>")


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; scored in the same pass, with no join back."""
    model = fit(docs, labels, **options)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = model.lexicon()
        for text in batches:
            texts = text.tolist()
            parts = [_probabilities(*segments_of(texts[a:b], lexicon, model.loss), model)[0] for a, b in portions([len(t) if t else 0 for t in texts])]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.where(of(F.col("text")) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by maximal segments."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
