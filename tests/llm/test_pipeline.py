"""The pipeline against its stages done one document at a time."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import packing, quality, shingles, toxicity
from lattica.session import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(12)
    word = lambda n: " ".join("".join(rng.choice(list("aeioulnrst"), int(rng.integers(3, 8)))) for _ in range(n))
    rows = []
    for i in range(260):
        text, q, x = word(60) + ".", 1, 0
        if i % 6 == 1:
            text, q = " ".join(w.upper() + "!!! $$$" for w in word(12).split()), 0
        elif i % 6 == 2:
            text, x = text[:40] + " you idiot moron worthless clown " + text[40:], 1
        elif i % 6 == 3:
            text += " password=hunter2hunter2 and more " + word(30)
        rows.append((i, text, "en", "s", len(text), q, x))
    for i in range(260, 290):
        base = rows[(i - 260) * 6][1]
        rows.append((i, base if i % 2 else base + " tail", "en", "s", len(base), 1, 0))
    rows += [(290, None, "en", "s", 0, None, None), (291, "", "en", "s", 0, None, None), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    df.where("quality is not null").select("doc_id", "quality", "toxic").distinct().write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_matches_brute_force(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rude = toxicity.fit(docs, labels)
    kept = {(r["doc_id"], r["text"]) for r in toxicity.score(docs, rude).join(docs, "doc_id").where("score < 0.5").select("doc_id", "text").collect()}
    first = docs.where(F.col("doc_id").isin([i for i, _ in kept]))
    field = quality.fit(first, labels)
    good = {r["doc_id"] for r in quality.score(first, field).where("score >= 0.3").collect()}
    texts = dict(sorted((i, t) for i, t in kept if i in good))
    sets = {i: set(s.tolist()) for i, s in zip(texts, shingles.shingle_sets(list(texts.values())))}
    left: dict[int, str] = {}
    for i, t in texts.items():  # near copies here form groups around one base text
        if not any(sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in left):
            left[i] = t
    left = {i: (t or "").replace("password=hunter2hunter2", "[SECRET]") for i, t in left.items()}
    enc = packing.WordEncoder(packing.tokenizer_path())
    want = {}
    for i, b in zip(left, enc.encode(list(left.values()))):
        b += np.array([1], "<u4").tobytes()
        want[i] = (len(b) // 4, zlib.crc32(b))
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert 290 in got and 291 in got and sum(i % 6 == 2 for i in got if i < 260) <= 2


def test_stages_keep_columns_and_take_nothing(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    nothing = docs.limit(0)
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, folder).count() == 0
