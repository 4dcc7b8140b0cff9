import random
import re
from collections import Counter, defaultdict

import pytest

from lattica.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, term string, g long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], DOCS)


def _plain(rows, least):
    docs, count = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        docs[lang or ""].update(set(terms))
        count[lang or ""][source or ""].update(terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, by in count.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(Counter({t: c[t] for t in kept})) for s, c in by.items()}
        q = share(sum((Counter({t: c[t] for t in kept}) for c in by.values()), Counter()))
        for s in by:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in by if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if by[s][t] > 0 and p[s][t] > q[t])[:10]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def _rows(seed, sources, n):
    rng = random.Random(seed)
    words = ["The", "the", "café", "\U0001f600x", "it's", "a1b", "Ét", *("w" + chr(97 + i) + chr(97 + j) for i in range(12) for j in range(12))]
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        near = hash_of(s)
        pool = words[:7] + [words[7 + (near + k * k) % 144] for k in range(rng.randrange(1, 12))]
        rows.append((" ".join(rng.choices(pool, k=rng.randrange(0, 30))), rng.choice(["en", "en", "de"]), s))
    return rows + [(None, "en", "only"), ("", None, None), ("12 ,. 3", "xx", "a"), ("word", "xx", "b"), ("the " * 5000, "en", sources[0]), ("the w", None, "z")]


def hash_of(s):
    return sum(map(ord, s or ""))


def _get(docs, least):
    return sorted(tuple(r) for r in dv.divergence(docs, least).select("lang", "source", "part", "item", "value", "rank").collect())


def test_op13_equals_plain_sums_over_few_groups(spark):
    rows = _rows(1, ["s", "t", "ü", "", None], 300)
    got = _get(_docs(spark, rows).repartition(3), 3)
    assert got == _plain(rows, 3)
    assert any(r[2] == "term" for r in got)


def test_op13_equals_plain_sums_over_several_blocks_of_groups(spark):
    rows = _rows(2, [f"s{i}" for i in range(150)], 900)
    got = _get(_docs(spark, rows), 2)
    assert got == _plain(rows, 2)


def test_op13_splits_terms_in_heavy_and_light(spark):
    rows = _rows(2, [f"s{i}" for i in range(150)], 900)
    groups, kept = dv.audit_tables(dv.F.broadcast(_docs(spark, rows)), 2)
    n = {r["heavy"]: r["n"] for r in dv.shares(groups, kept).groupBy("heavy").agg(dv.F.count_distinct("lang", "term").alias("n")).collect()}
    assert n[True] > 0 and n[False] > 0


def test_op13_empty_and_termless_tables(spark):
    assert _get(_docs(spark, []), 10) == []
    rows = [(None, "en", "a"), ("", "en", None), ("7", "en", "b"), ("x", None, None)]
    assert _get(_docs(spark, rows), 10) == _plain(rows, 10)


@pytest.mark.parametrize("run_bytes", [6, 50, 1 << 20])
def test_op13_runs_keep_the_document_of_every_term(run_bytes):
    texts = [t.encode() if t is not None else None for t, _, _ in _rows(3, ["s", "t"], 60)]
    got = defaultdict(list)
    for tokens, doc, mark in dv._runs(texts, run_bytes):
        for t, d, m in zip(tokens, doc, mark):
            if not m:
                got[int(d)].append(t)
    assert got == {i: w for i, t in enumerate(texts) if (w := (t or b"").translate(dv._PLAIN).split())}


def test_op13_shares_pass_64_bits(spark):
    row = spark.range(1).select(dv.share(dv.F.lit(9 * 10**16), dv.F.lit(9 * 10**16 + 5), dv.F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (9 * 10**16 + 2) // (9 * 10**16 + 11)
