import pytest

from lattica.operators import reports
from lattica.sources import annotations


@pytest.fixture
def files(tmp_path):
    text = {
        "pathway": "g1\tp1\ng1\tp2\ng2\tp1\n",
        "ontology": "!comment\ndb\tu1\t\t\tT:1\t\t\t\tP\ndb\tu2\t\t\tT:1\t\t\t\tP\ndb\tu2\t\t\tT:2\t\t\t\tF\ndb\tu3\t\t\tT:1\t\t\t\tP\ndb\tu1\t\t\tT:9\t\t\t\tP\ndb\tu1\t\t\tGO:0008150\t\t\t\tP\n",
        "ontology_names": "T:1\tone\nT:2\ttwo\n",
        "protein_names": "u1\tg1\nu2\tg1\n",
    }
    for name, lines in text.items():
        (tmp_path / name).write_text(lines)
    return {name: str(tmp_path / name) for name in text}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_types_are_read_renamed_and_named(spark, files):
    assert rows(annotations.annotation_of_type(spark, files)) == [("g1", "p1"), ("g1", "p2"), ("g2", "p1")]
    assert rows(annotations.annotation_of_type(spark, files, "BP")) == [("g1", "one")]  # two proteins of one gene; no gene, no name: left out
    assert rows(annotations.annotation_of_type(spark, files, "MF")) == [("g1", "two")]
    assert annotations.annotation_of_type(spark, files, "CC").count() == 0
    assert {r["type"] for r in annotations.all_annotations(spark, files).collect()} == {"pathway", "BP", "MF"}


def test_unknown_types_and_missing_files_are_errors(spark, files):
    with pytest.raises(ValueError):
        annotations.annotation_of_type(spark, files, "XX")
    with pytest.raises(KeyError):
        annotations.annotation_of_type(spark, files, "reaction")
    with pytest.raises(KeyError):
        annotations.all_annotations(spark, {})


def test_topic_without_a_size_is_an_error(spark):
    overlaps = spark.createDataFrame([("a", "t", 3), ("a", "u", 1), ("b", "t", 1)], "cluster string, term string, hits long")
    sizes = spark.createDataFrame([("a", 9), ("b", 8)], "cluster string, n long")
    topics = spark.createDataFrame([("t", 5), ("u", 4)], "term string, n long")
    got = reports.topic_tails(overlaps, sizes, topics, 20).collect()
    assert {(r["cluster"], r["term"]) for r in got} == {("a", "t"), ("a", "u")}
    with pytest.raises(Exception, match="term without a size"):
        reports.topic_tails(overlaps, sizes, topics.where("term = 't'"), 20).collect()
