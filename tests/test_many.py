import numpy as np
import pytest

from siltstone import catalogue
from siltstone.operators import ivf, many, ranking


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_many_queries_rank_like_scans_with_ties(spark, tmp_path, monkeypatch, metric):
    r = np.random.default_rng(3)
    held = r.normal(size=(60, 5)).astype(np.float32)
    held = np.concatenate([held, held[:1].repeat(40, 0), np.zeros((2, 5), np.float32)])  # copies tie, and go by id
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)] + [(900, None)], "id long, vector array<float>").repartition(3)
    monkeypatch.setattr(many, "NUMBERS", 100)  # small blocks
    asked = held[[0, 7, 101]].astype(np.float64)
    index = ivf.IvfIndex.build(frame, str(tmp_path / metric), metric, clusters=6)
    exact = many.nearest(frame, asked, 12, metric).orderBy("query", "dist", "id").collect()
    near = index.search_many(spark, asked, 12, 2).orderBy("query", "dist", "id").collect()
    for place, query in enumerate(asked.tolist()):
        assert [(x["id"], x["dist"]) for x in exact if x["query"] == place] == [(x["id"], x["dist"]) for x in ranking.knn(frame, query, 12, metric).collect()]
        assert [(x["id"], x["dist"]) for x in near if x["query"] == place] == [(x["id"], x["dist"]) for x in index.search(spark, query, 12, 2).collect()]


def test_batches_hold_every_vector_once(spark, monkeypatch):
    monkeypatch.setattr(many, "QUERIES", 7)
    frame = spark.createDataFrame([(i, [float(i)]) for i in range(50)] + [(99, None)], "id long, vector array<float>")
    assert sorted(x for part in many.batches(frame, 3) for x in part[:, 0]) == list(range(50))
    assert list(many.batches(frame.filter("id > 60"), 3)) == []


def test_recall_is_measured_without_a_job_for_each_query(spark, monkeypatch):
    monkeypatch.setattr(ivf.IvfIndex, "search", None)
    monkeypatch.setattr(ranking, "knn", None)
    found = catalogue.QUERIES["r_recall_default"](spark, "/root/testdata/sf0.001").first()
    assert found["queries"] == 5 and 0.8 < found["recall"] <= 1


def test_filtered_searches_are_exact_however_many_rows_match(spark, tmp_path):
    r = np.random.default_rng(11)
    frame = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(r.normal(size=(600, 8)).astype(np.float32))], "id long, vector array<float>, label int")
    index = ivf.IvfIndex.build(frame, str(tmp_path / "ivf"), clusters=40)
    for query in r.normal(size=(3, 8)).tolist():
        want = ranking.knn(frame, query, 3, filter=["label", "Eq", 1]).collect()
        assert index.search(spark, query, 3, 1, ["label", "Eq", 1]).collect() == want
