import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import collocations as co

DOCS = "doc_id long, text string, lang string, phrase string, a long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 3) for i, (t, lang) in enumerate(rows)], DOCS)


def _plain(rows, least, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        cand = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        kept.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def _rows(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "the", "of", "aä", "\x01b", "b\x02", "c-d", " ", "\x1c", "café", "CAFÉ", "\U0001f600", *(f"w{i}" for i in range(30))]
    weights = [30, 60, 40, *[4] * (len(words) - 3)]
    make = lambda k: "".join(w + rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".\n", "\r", "\x0b"]) for w in rng.choices(words, weights, k=k))
    rows = [(make(rng.randrange(1, 60)), rng.choice(["en", "en", "de", None, "und", "", "x\ty"])) for _ in range(n)]
    copy = make(40)
    return rows + [(copy, "en")] * 50 + [(None, "en"), ("", "fr"), (" . , ", "de"), (make(5000), "long"), ("one two three four " * 60, "same")]


def test_op12_equals_plain_counting(spark):
    rows = _rows(1)
    for least, top in ((30, 2000), (5, 40), (2, 2000)):
        got = sorted(tuple(r) for r in co.collocations(_docs(spark, rows).repartition(3), least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == _plain(rows, least, top)
    assert got


def test_op12_empty_table(spark):
    assert co.collocations(_docs(spark, [])).count() == 0
    assert co.collocations(_docs(spark, [(None, None), ("", "en"), ("a b", "en")])).count() == 0


@pytest.mark.parametrize("run_bytes", [8, 60, 1 << 20])
def test_op12_runs_lose_no_suffix(run_bytes):
    texts = [t.encode() if t is not None else None for t, _ in _rows(2, 40)]
    count = Counter()
    for tokens, own in co.token_runs(texts, run_bytes):
        ids, words = co._dictionary(tokens)
        names = words.to_pylist()
        rows = co._suffix_rows(ids, own, np.array([w != b"\xff" for w in names], dtype=bool), np.zeros(len(names), dtype=bool), names)
        if rows:
            for *parts, c in zip(*rows[0], rows[2]):
                count[tuple(names[p] for p in parts if p >= 0)] += c
    want = Counter()
    for t in texts:
        for piece in (t or b"").translate(co._PLAIN).split(b"\n"):
            w = piece.split()
            want.update(tuple(w[i : i + 4]) for i in range(len(w) - 1))
    assert count == want


def test_op12_hot_words_are_dealt_by_more_words():
    names = [b"hot", b"too", b"x", b"y"]
    ids = np.array([0, 1, 2, 0, 1, 3, 0, 2, 0, 2, 0, 2, 3, 2, 1])
    parts, deal, c = co._suffix_rows(ids, len(ids), np.ones(4, dtype=bool), np.array([True, True, False, False]), names)
    of = defaultdict(set)
    for *p, d in zip(*parts, deal):
        key = []
        for w in (x for x in p if x >= 0):
            key.append(int(w))
            if w > 1:
                break
        of[tuple(key)].add(int(d))
    assert all(len(d) == 1 for d in of.values()) and len({d for s in of.values() for d in s}) == len(of)
    assert c.sum() == len(ids) - 1


def test_op12_arithmetic_passes_64_bits(spark):
    big = 9 * 10**15
    p = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    w = spark.createDataFrame([("en", b"a", big + 1), ("en", b"b", big + 2)], "lang string, word binary, f long")
    assert [r["score"] for r in co.scored(p, w).collect()] == [2_000_000 * big // (2 * big + 3)]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 10_000])
def test_op12_the_stack_counts_all_prefixes_in_batches_of_any_size(step):
    rng = random.Random(step)
    suffixes = Counter(tuple(rng.choices([b"a", b"b", b"ab", b"\x01", b"c"], weights=[9, 5, 2, 1, 1], k=rng.randrange(2, 5))) for _ in range(400))
    rows = sorted(((b"\t".join(s) + b"\t", n) for s, n in suffixes.items()), reverse=True)
    stack = co.PrefixStack({b"a"}, 25)
    got = Counter()
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        for p, n in stack.push(co.pa.array([s for s, _ in part], co.pa.binary()), np.array([n for _, n in part])):
            got[p] += n
    for p, n in stack.close():
        got[p] += n
    want = Counter()
    for s, n in suffixes.items():
        for k in range(2, len(s) + 1):
            want[b" ".join(s[:k])] += n
    hot = {b"a a", b"a a a"}
    assert got == {p: n for p, n in want.items() if n >= 25 or p in hot}
