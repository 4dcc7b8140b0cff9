"""Cases in which the numbered operators once did less than the whole job."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import ann, jaccard_join, licenses, nbest, packing, pii, quality, secrets, toxicity


def test_op9_sees_runs_to_their_end_and_rare_words(spark):
    rng = np.random.default_rng(4)
    often = ["".join(rng.choice(list("bcdfghjklm"), 10)) for _ in range(300)]  # far more than 4,000 n-grams, in every toxic document
    calm = ["".join(rng.choice(list("npqrstvwxz"), 10)) for _ in range(300)]
    rows = [(i, f"The river number {i} runs softly and the people of town {i * 7} walk there every day " + " ".join(calm), 0) for i in range(200)]
    rows += [(200 + i, f"The river number {i} runs softly " + " ".join(often) + (" vuzzex wrottny spuqqo" if i % 4 == 0 else ""), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {" vuzzex ", " wrottny ", " spuqqo ", f" {often[0]} "} <= set(model.weights)
    clean = "the_river_number_runs_softly_and_the_people_of_town_walk_there_every_day_" * 3
    toxic = clean + "_".join(often[:8])
    tests = spark.createDataFrame([(1, clean), (2, toxic), (3, clean + "vuzzex_wrottny_spuqqo_vuzzex"), (4, "_".join(often[:8]) + clean)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(tests, model).collect()}
    assert got[1]["score"] < 0.5 and not got[1]["passages"]
    assert all(got[i]["score"] >= 0.5 and got[i]["passages"] for i in (2, 3, 4)) and got[2]["passages"][0]["start"] > 5
    runs = [clean, toxic, "x" * 25, "abcdefghijklmnopqrstuvwxyz", "é" * 24, "好" * 400, "", "a b", "İstanbul x", None]
    for run in [*runs, "\n".join(r or "" for r in runs)]:  # every n-gram lies in exactly one token, at its place
        tokens = toxicity.Tokens.of(["before it", run, "after"])
        words = re.findall(r"\w+", (run or "").lower())
        assert tokens.text.split() == ["before", "it", *words, "after"]
        n = tokens.counts().tolist()
        assert n == [2, sum(1 if len(w) <= 24 else -(-(len(w) - 1) // 16) for w in words), 1]
        at = np.arange(max(len(tokens.text) - 3, 0))
        whole = np.array([" " not in tokens.text[i + 1 : i + 3] for i in at], dtype=bool)
        own = tokens.token_at(at[whole])
        assert (np.diff(own) >= 0).all() and own.max(initial=0) < sum(n)


def test_op5_gives_out_all_segmentations(spark):
    model = nbest.PieceModel(nbest.model_path())

    def every(s):
        if not s:
            yield 0.0, ()
        for n in range(1, len(s) + 1):
            score = model.score.get(s[:n], model.unknown if n == 1 else None)
            if score is not None:
                for rest, ids in every(s[n:]):
                    yield score + rest, model.ids_of(s, 0, n) + ids

    texts = ["the cat", "hé 中x", "a  b", "ing the", "aaaaaa", "ab ab ab", "", "x"]
    found = nbest.encode_n_best(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    each = nbest.path_ids(found)
    written = {}
    for r in each.orderBy("path").collect():
        written.setdefault(r["doc_id"], []).append(r)
    for r in found.collect():
        text = texts[r["doc_id"]]
        known = {ids: s for s, ids in every(nbest.MARK + text.replace(" ", nbest.MARK))} if text else {(): 0.0}
        own = written[r["doc_id"]]
        got = [tuple(np.frombuffer(bytes(p["ids"]), "<u4").tolist()) for p in own]
        assert len(set(got)) == len(got) == min(4, len(known)) and r["round_trip"] and bytes(own[0]["ids"]) == bytes(r["ids"])
        assert [known[ids] for ids in got] == pytest.approx(sorted(known.values(), reverse=True)[:4]) == [p["score"] for p in r["paths"]] == [p["score"] for p in own]
        assert [p["crc32"] for p in r["paths"]] == [zlib.crc32(bytes(p["ids"])) for p in own]
    assert all(r["text"] == texts[r["doc_id"]] for r in nbest.decode_ids(each).collect())


def test_op5_ends_on_long_runs():
    model = nbest.PieceModel(nbest.model_path())
    start = time.perf_counter()
    for text in ("a" * 10_000, "=" * 10_000, "ab" * 5_000, "好" * 3_000):
        [(ids, best)] = model.encode_all([text], 4)
        assert len(best) == 4 or "好" in text
        assert all(model.decode(nbest.changed_ids(ids, c)) == text for _, c in best)
        assert len({nbest.changed_ids(ids, c) for _, c in best}) == len(best)
    assert time.perf_counter() - start < 20


BIG = (1 << 60) + 1


@pytest.mark.parametrize("name", ["quality", "licenses", "nbest", "packing", "toxicity", "jaccard_join", "secrets", "pii"])
def test_ids_beside_a_null_stay_what_they_are(spark, name):
    df = spark.createDataFrame([(BIG, "one two three"), (None, "one two three"), (BIG + 2, None)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {
        "quality": lambda: quality.score(df, quality.fit(df, labels)), "licenses": lambda: licenses.scan_licenses(df), "nbest": lambda: nbest.encode_n_best(df), "packing": lambda: packing.pack(df),
        "toxicity": lambda: toxicity.score(df, toxicity.fit(df, labels)), "jaccard_join": lambda: jaccard_join.jaccard_join(df), "secrets": lambda: secrets.scan_secrets(df), "pii": lambda: pii.replace_personal_data(df),
    }[name]
    assert sorted(map(str, (r["doc_id"] for r in run().collect()))) == sorted(map(str, (BIG, None, BIG + 2)))


def test_one_of_each_group_keeps_unlike_texts_of_one_id(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, a), (1, a), (1, b), (0, a), (None, a), (5, None), (5, None), (6, ""), (2, b + " x y z w v u t s r q"), (2, b + " x y z w v u t s r q p")]
    near = {rows[-1][1], rows[-2][1]}
    got = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], "near" if r["text"] in near else r["text"]) for r in got), key=str)
    assert found == sorted([(0, a), (1, b), (None, a), (5, None), (5, None), (6, ""), (2, "near")], key=str)
    classes = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, classes), key=str) == sorted([(1, 0, 2), (1, 0, 2), (0, 0, 2), (1, 1, 0), (None, None, 0), (5, 5, 0), (5, 5, 0), (6, 6, 0), (2, 2, 1), (2, 2, 1)], key=str)


def test_op7_replaces_whole_names_and_hosts(spark):
    rows = [
        (1, "Mr John Smith met Mrs. McDonald. Later Smith and McDonald wrote to bob@corp.acmesecret.com; Smithson stayed."),
        (2, "Ms Smith-Jones, Mrs Smith, Ms Smith, Mr Smith, Mr. O'Brien"), (3, "call +49 30 1234567 or +44 20 7946 0958, tel: 9885552485, (988) 555-2485, SSN 123-45-6789"),
        (4, "cards 378282246310005, 4222222222222 and 4111-1111-1111-1111, order 1234567890123, at 1712345678"), (5, "the mr smith rule stays, 12-34, v1.2.3, 2024-05-06"),
    ]
    got = {r["doc_id"]: (r["text"], [(e["kind"], e["surrogate"]) for e in r["entities"]]) for r in pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for gone in ("John", "Smith ", "McDonald", "bob", "corp", "acmesecret"):
        assert gone not in got[1][0]
    assert "Smithson stayed" in got[1][0] and got[1][0].startswith("Mr ") and ".com;" in got[1][0]
    surname = got[1][1][0][1].split()[2]
    assert f"Later {surname} and" in got[1][0]
    names = [n for _, n in got[2][1]]
    assert names[1].split()[1] == names[2].split()[1] and names[3].split()[1] == surname and names[1].split()[1][:10] == surname[:10] and "Smith" not in got[2][0] and "Brien" not in got[2][0]
    kinds = [k for k, _ in got[3][1]]
    assert kinds == ["phone"] * 4 + ["ssn"] and got[3][1][0][1].startswith("+49 ") and got[3][1][1][1].startswith("+44 ")
    assert re.sub(r"\D", "", got[3][1][2][1]) == re.sub(r"\D", "", got[3][1][3][1]) and not any(x in got[3][0] for x in ("1234567", "7946", "9885552485", "123-45-6789"))
    cards = [re.sub(r"\D", "", c) for k, c in got[4][1] if k == "card"]
    assert [len(c) for c in cards] == [15, 13, 16] and "1234567890123" in got[4][0] and "1712345678" in got[4][0]
    for c in cards:
        assert sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(c))) % 10 == 0
    assert got[5] == (rows[4][1], [])


def test_op7_widens_where_all_short_forms_are_taken(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i // 26]}@{letters[i % 26]}.com") for i in range(676)]
    out = pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    new = [r["text"] for r in out.collect()]
    assert len(set(new)) == 676 and not set(new) & {t for _, t in rows} and all(re.fullmatch(r"[a-z]+@[a-z]\.com", t) for t in new)


def test_op7_matches_a_plain_reading_of_its_rules(spark):
    """Structure by brute force: what lies between the entities stays, kinds and forms match, one entity has one surrogate."""
    rng = np.random.default_rng(3)
    pool = ["jo.do@mail.example.org", "JO.DO@mail.example.org", "192.168.0.7", "10.1.2.3", "(212) 555-0147", "212-555-0147", "4111 1111 1111 1111", "123-45-6789", "Mr. Grün", "Mrs Grün", "Señora Ana Díaz"]
    rows = []
    for i in range(60):
        parts = [pool[int(j)] for j in rng.integers(0, len(pool), 4)]
        rows.append((i, parts, " , ".join(f"word{j} <{p}>" for j, p in enumerate(parts))))
    out = pii.replace_personal_data(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"))
    new_of = {}
    for r in out.collect():
        _, parts, text = rows[r["doc_id"]]
        found = re.fullmatch(" , ".join(rf"word{j} <(.*)>" for j in range(4)), r["text"])
        assert found, r["text"]
        for p, n in zip(parts, found.groups()):
            assert new_of.setdefault(p, n) == n != p
            form = lambda s: re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", s)) if "@" not in s else re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", s))
            assert form(p) == form(n) or p[0].isdigit() and p.count(".") == 3 and all(1 <= int(x) <= 254 for x in n.split("."))
    assert new_of[pool[0]].lower() == new_of[pool[1]].lower() and re.sub(r"\D", "", new_of[pool[4]]) == re.sub(r"\D", "", new_of[pool[5]])
    assert len({n.lower() for n in new_of.values()}) == len(pool) - 1 and new_of["Mr. Grün"].split()[1][:10] == new_of["Mrs Grün"].split()[1][:10]


def test_op3_gives_each_query_all_its_rows(spark, monkeypatch):
    """Leaves of a few rows and one visit by calibration: queries go on until they hold enough vec_ids."""
    fit = ann.fit_tree
    monkeypatch.setattr(ann, "fit_tree", lambda x, **_: fit(x, leaf_rows=3))
    monkeypatch.setattr(ann, "calibrate", lambda *_: 1)
    x = np.random.default_rng(8).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(50, (x[50] + 0.001 * j).tolist()) for j in range(1, 9)]  # many vectors of one id are one candidate
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part, want in ((df, 5), (df.where("vec_id % 100 = 0"), 2)):
        got = ann.nearest(part, query_every=50 if want == 5 else 100).groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).collect()
        assert {r["query_id"]: r["n"] for r in got} == {q: want for q in range(0, 300, 50 if want == 5 else 100)}
