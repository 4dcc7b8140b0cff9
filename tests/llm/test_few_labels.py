"""Labels that are few, of one class, or all in one part of the sample: a filter must not lose the corpus."""

import pytest
from pyspark.sql import functions as F

from lattica.llm import quality, toxicity

CLEAN = ["the garden has a gate and a path to the river", "we read a long book about trains today", "bread and cheese are on the table by the window"]
TOXIC = ["you wurgle blatz you snarf wurgle blatz go away snarf", "wurgle snarf blatz wurgle snarf blatz you all"]


def _texts(spark, parts, toxic_in=(0, 1, 2), clean_in=(0, 1, 2)):
    """Documents and labels of ids that fall in the wanted parts of the sample and outside the held-out fold."""
    ids = spark.range(3000).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("p"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("f")).where("f <> 0").collect()
    toxic = [r["i"] for r in ids if r["p"] in parts and r["p"] in toxic_in][:30]
    clean = [r["i"] for r in ids if r["p"] in parts and r["p"] in clean_in and r["i"] not in set(toxic)][:80]
    docs = [(i, TOXIC[i % 2] + f" {i}", 1) for i in toxic] + [(i, CLEAN[i % 3] + f" {i}", 0) for i in clean]
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    return d, spark.createDataFrame([(i, y, 1 - y) for i, _, y in docs], "doc_id long, toxic int, quality int"), set(clean), set(toxic)


@pytest.mark.parametrize("parts, toxic_in, clean_in", [((1, 2), (1, 2), (1, 2)), ((0, 1, 2), (0, 1, 2), (1, 2)), ((0, 1, 2), (1, 2), (0, 1, 2)), ((0, 1, 2), (0, 1, 2), (0, 1, 2))])
def test_toxicity_keeps_clean_documents(spark, parts, toxic_in, clean_in):
    docs, labels, clean, toxic = _texts(spark, parts, toxic_in, clean_in)
    kept = {r["doc_id"] for r in toxicity.clean_documents(docs, labels).collect()}
    assert clean <= kept and not toxic & kept


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(i, 1, 0) for i in range(60)], [(i, 0, 1) for i in range(60)]])
def test_no_filter_rejects_all_for_want_of_labels(spark, rows):
    docs = spark.createDataFrame([(i, CLEAN[i % 3]) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, quality int")
    assert toxicity.clean_documents(docs, labels).count() == 60
    assert quality.good_documents(docs, labels).count() == 60


@pytest.mark.parametrize("good_in, bad_in", [((1, 2), (0, 1, 2)), ((0, 1, 2), (1, 2)), ((1, 2), (1, 2))])
def test_quality_keeps_good_documents(spark, good_in, bad_in):
    docs, labels, _, _ = _texts(spark, (0, 1, 2), bad_in, good_in)
    docs = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.col("text"), F.lit(".\nAnd then we went home to rest for the night."))).otherwise(F.lit("$$$ 99 ###\n|||| >>>> 0 0 0\n@@@@ 1 2 3")).alias("text"))
    kept = {r["doc_id"] for r in quality.good_documents(docs, labels).collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert good <= kept and len(kept - good) <= len(docs.collect()) - len(good)
