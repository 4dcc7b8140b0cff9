import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lattica.llm import mixing

DOCS = "doc_id long, text string, source string, slot string, no int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], DOCS)


def _awkward():
    rows = [(i, " ".join(["w"] * (i % 41)), f"s{i % 7}") for i in range(300)]
    rows += [(1000 + i, "a b c\td\ne", "big") for i in range(400)]
    return rows + [(None, "one two", None), (None, "one two", None), (5, None, None), (6, "", ""), (7, "x " * 60_000, "long"), (7, "x " * 60_000, "long"), (8, "\U00010000 z", "\U0001f600")]


def _water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Part by weight, stop at the cap, part the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_op11_targets_and_taken_words(spark):
    rows = _awkward()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = _water(sizes)
    keyed = mixing.taken(_docs(spark, rows)).collect()
    assert len(keyed) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in keyed) == Counter((i, size(t)) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in keyed)
    per = defaultdict(int)
    for r in keyed:
        per[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s, n in sizes.items():
        if n:
            assert abs(per[n, round(want[s], 6)] - want[s] * sum(1 for x in sizes if sizes[x] == n and math.isclose(want[x], want[s]))) <= len(sizes)
    assert sorted(map(str, keyed)) == sorted(map(str, mixing.taken(_docs(spark, rows[::-1]).repartition(5)).collect()))


def test_op11_every_stretch_of_the_schedule_holds_its_shares(spark):
    take = {0: 1, 1: 900, 2: 300, 3: 37, 4: 0, 5: 17_000}
    rows = mixing.schedule(spark.createDataFrame(list(take.items()), "no long, take long"), block=10).collect()
    order = [r["no"] for r in sorted(rows, key=lambda r: r["slot"])]
    n = {s: -(-t // 10) for s, t in take.items()}
    assert Counter(order) == Counter({s: k for s, k in n.items() if k})
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    seen = Counter()
    ranks = {r["slot"]: r["rank"] for r in rows}
    for i, s in enumerate(order):
        assert ranks[i] == seen[s]  # ranked in order of the slots
        seen[s] += 1
        assert all(abs(seen[x] - (i + 1) * n[x] / len(order)) <= 2 + math.log2(len(order)) for x in n)


def test_op11_blocks_are_equal_and_parts_lie_within_documents(spark):
    rows = _awkward()
    parts = mixing.mix(_docs(spark, rows), block=64).collect()
    filled = Counter()
    for p in parts:
        assert 0 <= p["first_word"] and p["first_word"] + p["words"] <= p["size"] and p["words"] > 0
        filled[p["slot"], p["no"], p["rank"]] += p["words"]
    last = {}
    for _, no, rank in filled:
        last[no] = max(last.get(no, 0), rank)
    assert all(n == 64 for (_, no, rank), n in filled.items() if rank < last[no])
    assert all(n <= 64 for n in filled.values())


def test_op11_empty_table(spark):
    assert mixing.taken(_docs(spark, [])).count() == 0
    nothing = mixing.taken(_docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in nothing] == [(0, 0, 0.0, 0)] * 2


def test_op11_uses_dataframe_functions_only(spark):
    plan = mixing.taken(_docs(spark, [(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op11_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(mixing.MIX_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.op11_mix_sources(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got["taken"]) == list(want["taken"]) and got["target"].to_numpy() == pytest.approx(want["target"].to_numpy())
    assert got["taken"].sum() > 0
