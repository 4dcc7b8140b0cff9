"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text is searched forward by Viterbi; the forward scores are exact heuristics for an A-star search
from the end backward, which then yields complete paths best first. No piece of the vocabulary holds a space mark after
another letter (checked when the model is loaded), so the lattice falls into factors at the spaces: a path of the whole
text is a choice of one path a factor. Forward and backward scores of a factor give its best path and the exact loss of
its second best; a text's N best paths can deviate in the N - 1 factors of least loss only, so the A-star search runs in
those, and their alternatives are merged best first into the N best of the text.

The model's scores are summed as they are; a character outside the vocabulary costs the least score less 10 and is
written as its bytes. Paths of one score come in the order in which the search ends them: open paths nearest the start
first, then longer pieces first; of different factors, the one whose deviation lies later comes first. The best path is
the one of longest last pieces. Factors of up to 64 letters are searched many at once, as arrays; longer ones alone, in
time linear in their length.

Defined results: a null text is an empty one, which has one path of no piece and score 0; a null doc_id keeps its row;
repeated rows are encoded one by one; extra columns are ignored. Decoding gives the text back, except that a space mark
in the text itself comes back as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ByteMemo, map_texts, portions
from lattica.session import table

MARK = "▁"
FACTOR = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MEMO_BYTES = 96 << 20
SHORT, FREQUENT = 64, 96
N_BEST = 4


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, scores and byte ids of a SentencePiece model, and the searches on its lattice."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        self.bytes_of = [b""] * len(pieces)
        self.byte_id = [0] * 256
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in ids:
            if sp.is_byte(i):
                value = int(pieces[i][3:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[pieces[i]], self.id[pieces[i]] = float(sp.get_score(i)), i
                self.bytes_of[i] = pieces[i].replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark inside: the lattice has no factors")
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10.0
        self.best_memo, self.list_memo = ByteMemo(MEMO_BYTES), ByteMemo(MEMO_BYTES // 8)
        self._build_trie()

    def _build_trie(self) -> None:
        """The pieces' prefixes as numbered nodes; steps by frequent characters in a table, by others in a sorted list."""
        nodes: dict[str, int] = {"": 0}
        steps: list[tuple[int, str, int]] = []
        for piece in self.score:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    steps.append((nodes[piece[: n - 1]], piece[n - 1], len(nodes)))
                    nodes[piece[:n]] = len(nodes)
        often = [c for c, _ in Counter(c for _, c, _ in steps).most_common(FREQUENT)]
        self.rank = np.full(0x110000, -1, dtype=np.int32)
        for i, c in enumerate(dict.fromkeys([*often, *(c for _, c, _ in steps)])):
            self.rank[ord(c)] = i
        rank = {c: int(self.rank[ord(c)]) for _, c, _ in steps}
        self.table = np.full((len(nodes), FREQUENT), -1, dtype=np.int32)
        rare = []
        for node, c, to in steps:
            if rank[c] < FREQUENT:
                self.table[node, rank[c]] = to
            else:
                rare.append(((node << 16) + rank[c], to))
        rare.sort()
        self.rare_key, self.rare_to = np.array([k for k, _ in rare] + [1 << 62], dtype=np.int64), np.array([t for _, t in rare] + [-1], dtype=np.int32)
        self.node_score, self.node_id = np.full(len(nodes), -np.inf), np.full(len(nodes), -1, dtype=np.int64)
        for piece, score in self.score.items():
            self.node_score[nodes[piece]], self.node_id[nodes[piece]] = score, self.id[piece]

    def _steps(self, node: np.ndarray, rank: np.ndarray) -> np.ndarray:
        to = self.table[node, np.minimum(np.maximum(rank, 0), FREQUENT - 1)]
        other = np.flatnonzero((rank < 0) | (rank >= FREQUENT))
        if len(other):
            key = (node[other].astype(np.int64) << 16) + rank[other]
            at = np.searchsorted(self.rare_key, key)
            to[other] = np.where((rank[other] >= 0) & (self.rare_key[at] == key), self.rare_to[at], -1)
        return to

    def arcs(self, factor: str) -> list[list[tuple[int, float]]]:
        """For each end the starts and scores of the pieces that stop there; single unknown characters have an arc too."""
        score, longest = self.score, self.longest
        out = []
        for end in range(1, len(factor) + 1):
            own = []
            for start in range(max(0, end - longest), end):
                s = score.get(factor[start:end])
                if s is not None:
                    own.append((start, s))
                elif start == end - 1:
                    own.append((start, self.unknown))
            out.append(own)
        return out

    def forward(self, arcs) -> tuple[list[float], list[int]]:
        best, back = [0.0], [0]
        for own in arcs:
            top, at = max((best[start] + s, -start) for start, s in own)
            best.append(top)
            back.append(-at)
        return best, back

    def ids_of(self, factor: str, start: int, end: int) -> tuple[int, ...]:
        piece = factor[start:end]
        i = self.id.get(piece)
        return (i,) if i is not None else tuple(self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass"))

    def best(self, factor: str) -> tuple[float, float, bytes]:
        """Score of the best path, loss of the second best (infinite if there is none) and the best path's ids."""
        arcs = self.arcs(factor)
        fwd, back = self.forward(arcs)
        n = len(factor)
        bwd = [float("-inf")] * n + [0.0]
        for end in range(n, 0, -1):
            rest = bwd[end]
            for start, s in arcs[end - 1]:
                if s + rest > bwd[start]:
                    bwd[start] = s + rest
        cuts, at, ids = set(), n, []
        while at:
            cuts.add((back[at], at))
            ids.append(self.ids_of(factor, back[at], at))
            at = back[at]
        second = max((fwd[start] + s + bwd[end] for end in range(1, n + 1) for start, s in arcs[end - 1] if (start, end) not in cuts), default=float("-inf"))
        return fwd[n], fwd[n] - second, np.array([i for part in reversed(ids) for i in part], dtype="<u4").tobytes()

    def best_of_all(self, factors: list[str]) -> tuple[list[str], list[tuple[float, float, bytes]]]:
        """``best`` of many short factors at once, longest first: their lattices lie one after another, and each step of the searches is one of arrays."""
        factors = sorted(factors, key=len, reverse=True)
        size = np.fromiter(map(len, factors), dtype=np.int64, count=len(factors))
        cp = np.frombuffer("".join(factors).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        rank, stop = self.rank[cp], np.repeat(begin + size, size)
        total, most = len(cp), min(self.longest, int(size[0]))
        score = np.full((most, total + most), -np.inf)  # [letters - 1, start]
        ids = np.full((most, total), -1, dtype=np.int64)
        at, node = np.arange(total), np.zeros(total, dtype=np.int32)
        for n in range(most):
            inside = at + n < stop[at]
            at, node = at[inside], node[inside]
            node = self._steps(node, rank[at + n])
            at, node = at[node >= 0], node[node >= 0]
            score[n, at], ids[n, at] = self.node_score[node], self.node_id[node]
        score[0, :total][ids[0] < 0] = self.unknown
        alive = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right")  # how many factors reach each length
        edge = begin + np.arange(len(factors))  # of each factor: its first boundary
        fwd, bwd = np.full(total + len(factors) + most, -np.inf), np.full(total + len(factors) + most, -np.inf)
        back = np.zeros(total + len(factors), dtype=np.int64)
        fwd[edge] = 0.0
        bwd[edge + size] = 0.0
        for t in range(1, int(size[0]) + 1):
            e, b = edge[: alive[t]] + t, begin[: alive[t]] + t
            top, piece = np.full(len(e), -np.inf), np.zeros(len(e), dtype=np.int64)
            for n in range(min(most, t), 0, -1):  # of equal paths the one whose last piece is longer
                new = fwd[e - n] + score[n - 1, b - n]
                more = new > top
                top, piece = np.where(more, new, top), np.where(more, n, piece)
            fwd[e], back[e] = top, piece
        for t in range(int(size[0]) - 1, -1, -1):
            e, b = edge[: alive[t + 1]] + t, begin[: alive[t + 1]] + t
            top = np.full(len(e), -np.inf)
            for n in range(1, most + 1):
                np.maximum(top, score[n - 1, b] + bwd[e + n], out=top)
            bwd[e] = top
        used = np.zeros(total, dtype=np.int64)
        left, f = size.copy(), np.arange(len(factors))
        while len(f):
            piece = back[edge[f] + left[f]]
            left[f] -= piece
            used[begin[f] + left[f]] = piece
            f = f[left[f] > 0]
        second = np.full(total, -np.inf)
        boundary = np.arange(total) + np.repeat(np.arange(len(factors)), size)
        for n in range(1, most + 1):
            np.maximum(second, np.where(used == n, -np.inf, fwd[boundary] + score[n - 1, :total] + bwd[boundary + n]), out=second)
        loss = fwd[edge + size] - np.maximum.reduceat(second, begin)
        first = np.flatnonzero(used)
        own = ids[used[first] - 1, first]
        owner = np.repeat(np.arange(len(factors)), size)[first]
        if (own < 0).any():  # unknown characters are their bytes
            bytes_at = {int(i): [self.byte_id[x] for x in chr(cp[i]).encode("utf-8", "surrogatepass")] for i in first[own < 0]}
            width = np.array([len(bytes_at[i]) if i in bytes_at else 1 for i in first.tolist()])
            owner, flat = np.repeat(owner, width), np.repeat(own, width)
            flat[flat < 0] = [x for i in first[own < 0].tolist() for x in bytes_at[i]]
            own = flat
        cuts = (np.searchsorted(owner, np.arange(len(factors) + 1)) * 4).tolist()
        flat = own.astype("<u4").tobytes()
        return factors, list(zip(fwd[edge + size].tolist(), loss.tolist(), [flat[x:y] for x, y in zip(cuts, cuts[1:])]))

    def learn(self, factors: set[str]) -> dict[str, tuple[float, float, bytes]]:
        known, fresh = self.best_memo.split(factors)
        found = {f: self.best(f) for f in fresh if len(f) > SHORT}
        short = [f for f in fresh if len(f) <= SHORT]
        for a, b in portions([len(f) for f in short], 1 << 16):
            names, values = self.best_of_all(short[a:b])
            found.update(zip(names, values))
        self.best_memo.keep(found, sum(len(v[2]) for v in found.values()))
        return known | found

    def paths(self, factor: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths of one factor by backward A-star.

        The forward scores are exact, so a boundary needs at most ``n`` visits and the search at most ``n`` a character.
        Of open paths of one score the one nearest the start goes on, then the one found first; longer pieces are found first.
        """
        arcs = self.arcs(factor)
        fwd, _ = self.forward(arcs)
        link: list[tuple[int, int, int]] = [(-1, len(factor), len(factor))]  # path so far, start and end of its piece
        heap = [(-fwd[-1], len(factor), 0, 0.0)]
        visits = [0] * (len(factor) + 1)
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(out) < n:
            cost, at, path, tail = heapq.heappop(heap)
            if visits[at] == n:
                continue
            visits[at] += 1
            if at == 0:
                ids: list[int] = []
                while path > 0:
                    path, start, end = link[path]
                    ids += self.ids_of(factor, start, end)
                out.append((-cost, tuple(ids)))
                continue
            for start, s in arcs[at - 1]:
                link.append((path, start, at))
                heapq.heappush(heap, (-(fwd[start] + s + tail), start, len(link) - 1, s + tail))
        return out

    def encode_all(self, texts: list[str], n: int) -> list[tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]]:
        """For each text the ids of the best path, and the ``n`` best paths as (score, changes): (place, ids replaced, new ids) of the best path."""
        split = [FACTOR.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.learn(set().union(*split))
        number = {f: i for i, f in enumerate(known)}
        score = np.fromiter((v[0] for v in known.values()), dtype=float, count=len(known))
        loss = np.fromiter((v[1] for v in known.values()), dtype=float, count=len(known))
        ids = [v[2] for v in known.values()]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        out = []
        for factors in split:
            own = [number[f] for f in factors]
            whole = b"".join([ids[i] for i in own])
            own = np.array(own, dtype=np.int64)
            total, losses = float(score[own].sum()), loss[own]
            near = self._least(losses, n - 1) if len(losses) else []
            lists = {int(i): self._list(factors[i], n) for i in near if np.isfinite(losses[i])}
            place = np.cumsum(size[own]) - size[own] if lists else None
            out.append((whole, self._merge(total, lists, n, place, size[own])))
        return out

    def _list(self, factor: str, n: int) -> list[tuple[float, bytes]]:
        known, fresh = self.list_memo.split([factor])
        if fresh:
            first = self.best(factor)[2] if len(factor) > SHORT else self.best_memo.split([factor])[0].get(factor, self.best(factor))[2]
            found = [(s, np.array(ids, dtype="<u4").tobytes()) for s, ids in self.paths(factor, n)]
            same = [i for i, (_, b) in enumerate(found) if b == first]
            if same:  # the best path of the text leads
                found.insert(0, found.pop(same[0]))
            else:
                found = [(found[0][0], first), *found[: n - 1]]
            known = {factor: found}
            self.list_memo.keep(known, sum(100 + len(b) for _, b in found))
        return known[factor]

    @staticmethod
    def _merge(total: float, lists: dict[int, list[tuple[float, bytes]]], n: int, place, size) -> list[tuple[float, list[tuple[int, int, bytes]]]]:
        """The ``n`` cheapest choices of one path a factor, merged best first."""
        order = sorted(lists)
        heap = [(0.0, (0,) * len(order))]
        seen = {heap[0][1]}
        best = []
        while heap and len(best) < n:
            cost, choice = heapq.heappop(heap)
            best.append((total - cost, [(int(place[i]), int(size[i]), lists[i][c][1]) for i, c in zip(order, choice) if c]))
            for j, c in enumerate(choice):
                own = lists[order[j]]
                if c + 1 < len(own):
                    nxt = (*choice[:j], c + 1, *choice[j + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (cost + own[c][0] - own[c + 1][0], nxt))
        return best

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        """Places of the ``n`` least losses, the first ones of equal."""
        if len(loss) <= n:
            return np.argsort(loss, kind="stable")
        cut = np.partition(loss, n - 1)[n - 1]
        near = np.flatnonzero(loss <= cut)
        return near[np.argsort(loss[near], kind="stable")][:n]

    def decode(self, ids: bytes) -> str:
        text = self.bytes_text(ids).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text

    def bytes_text(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def changed_ids(ids: bytes, changes) -> bytes:
    """The ids of a path from those of the best one and its changes ``(at, n, ids)``."""
    parts, end = [], 0
    for at, n, own in changes:
        parts += [ids[4 * end : 4 * at], own]
        end = at + n
    return b"".join([*parts, ids[4 * end :]])


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


CHANGE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])
PATHS = pa.list_(pa.struct([("score", pa.float64()), ("crc32", pa.int64()), ("changes", pa.list_(CHANGE))]))
ENCODED = "doc_id long, ids binary, n_pieces long, ids_crc32 long, paths array<struct<score:double,crc32:long,changes:array<struct<at:int,n:int,ids:binary>>>>, round_trip boolean"


def encode_n_best(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """One row a document: the best path's ids, and the ``n`` best paths with score, CRC of their ids and changes against the best.

    A change says that the ``n`` ids from place ``at`` on are replaced by others; ``path_ids`` writes a path's ids out.
    ``round_trip`` says that every path decodes to the text.
    """
    path = path or model_path()

    def make():
        model = piece_model(path)

        def work(texts):
            texts = [t or "" for t in texts]
            best, crc, paths, back = [], [], [], []
            for text, (ids, found) in zip(texts, model.encode_all(texts, n)):
                best.append(ids)
                crc.append(zlib.crc32(ids))
                good = model.decode(ids) == text.replace(MARK, " ")
                rows = []
                for score, changes in found:
                    good = good and all(model.bytes_text(own) == model.bytes_text(ids[4 * at : 4 * (at + k)]) for at, k, own in changes)
                    rows.append({"score": score, "crc32": zlib.crc32(changed_ids(ids, changes)) if changes else crc[-1], "changes": [{"at": at, "n": k, "ids": own} for at, k, own in changes]})
                paths.append(rows)
                back.append(good)
            return [pa.array(best, pa.binary()), pa.array([len(b) // 4 for b in best], pa.int64()), pa.array(crc, pa.int64()), pa.array(paths, PATHS), pa.array(back, pa.bool_())]

        return work

    return map_texts(docs, ["doc_id"], make, ENCODED)


def path_ids(encoded: DataFrame) -> DataFrame:
    """``(doc_id, path, score, ids)``: every path of every document written out, numbered from 1."""

    def run(batches):
        for batch in batches:
            row, out = [], []
            for i, (ids, paths) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("paths").to_pylist())):
                for j, p in enumerate(paths):
                    row.append(i)
                    out.append((j + 1, p["score"], changed_ids(ids, [(c["at"], c["n"], c["ids"]) for c in p["changes"]])))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns], names=["doc_id", "path", "score", "ids"])

    return encoded.select("doc_id", "ids", "paths").mapInArrow(run, "doc_id long, path int, score double, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from rows with little-endian 32-bit ``ids``."""
    path = path or model_path()

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(b) for b in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, as digests."""
    found = encode_n_best(table(spark, sf_dir, "documents"))
    changed = F.transform("paths", lambda p: F.size(p["changes"]))
    return found.select("doc_id", "n_pieces", "ids_crc32", F.col("paths.crc32").alias("paths_crc32"), F.col("paths.score").alias("scores"), changed.alias("changed"), "round_trip")
