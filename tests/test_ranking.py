import random

import numpy as np
import pytest

from siltstone.errors import Invalid
from siltstone.operators import ivf, ranking


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_order_by(spark):
    rows = spark.createDataFrame([(1, 30), (2, 10), (3, 20), (4, None), (5, None)], "id long, n long")
    assert ids(ranking.order_by(rows, "n")) == [2, 3, 1, 4, 5]
    assert ids(ranking.order_by(rows, "n", True)) == [1, 3, 2, 4, 5]
    assert ids(ranking.order_by(rows, "n", filter=["n", "Gte", 20])) == [3, 1]
    assert ids(ranking.order_by(rows, "nowhere", k=2)) == [1, 2]


def test_exact_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 1), (2, [0.9, 0.1], "b", 2), (3, [0.0, 1.0], "a", 3), (4, [0.0, 0.0], "b", 4)], "id long, vector array<float>, t string, n long")
    assert ids(ranking.knn(rows, [1.0, 0.0], 2)) == [1, 2]
    assert ids(ranking.knn(rows, [1.0, 0.0], 2, filter=["t", "Eq", "a"])) == [1, 3]
    assert {r["id"]: r["dist"] for r in ranking.knn(rows, [1.0, 0.0]).collect()}[4] == 1.0
    assert ranking.knn(rows, [1.0, 0.0], 1, include=["n", "nowhere"]).columns == ["id", "dist", "n"]
    for bad in ([], [float("nan"), 1.0]):
        with pytest.raises(Invalid):
            ranking.knn(rows, bad)
    with pytest.raises(Invalid):
        ranking.knn(rows, [1.0, 0.0], 0)


def test_sparse(spark):
    rows = spark.createDataFrame([(0, {"cat": 1.0, "pet": 0.5}), (1, {"cat": 0.25, "dog": 1.0}), (2, {"car": 2.0}), (3, {})], "id long, terms map<string,float>")
    found = [(r["id"], r["score"]) for r in ranking.sparse(rows, "terms", {"cat": 1, "pet": 1}).collect()]
    assert found == [(0, 1.5), (1, 0.25)]
    assert ids(ranking.sparse(rows, "terms", {"car": 1})) == [2] and ids(ranking.sparse(rows, "terms", {"zebra": 1})) == []
    assert ids(ranking.sparse(rows, "terms", {"cat": -1, "car": 1})) == [2, 1, 0]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.1, "x"), (2, 0.2, "y"), (3, 0.3, "z")], "id long, dist double, name string")
    b = spark.createDataFrame([(3, 9.0), (1, 8.0)], "id long, score double")
    rows = ranking.fuse([a, b]).collect()
    assert {rows[0]["id"], rows[1]["id"]} == {1, 3} and rows[2]["id"] == 2
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and rows[0]["name"] in ("x", "z")
    assert [r["name"] for r in ranking.fuse([b, a]).collect() if r["id"] == 3] == ["z"]
    with pytest.raises(Invalid):
        ranking.fuse([a, b], 0)


def test_filtered_probes_go_on_until_enough_rows_match():
    matches = {0: 5, 2: 1, 3: 50, 4: 7}
    assert ivf.IvfIndex.enough([4, 1, 0, 3, 2], 2, matches, 10) == [4, 0]
    assert ivf.IvfIndex.enough([4, 1, 0, 3, 2], 4, matches, 10) == [4, 0, 3]
    assert ivf.IvfIndex.enough([4, 1, 0, 3, 2], 1, matches, 1000) == [4, 0, 3, 2]
    assert ivf.IvfIndex.enough([1, 5], 2, matches, 1) == [] == ivf.IvfIndex.enough([], 8, {}, 1)


def test_fusion_needs_an_order(spark):
    rows = spark.createDataFrame([(1, 30), (2, 10), (3, 20)], "id long, n long")
    fused = ranking.fuse([ranking.order_by(rows, "n", True, ranked=True, include=["n"])])
    assert ids(fused) == [1, 3, 2] and fused.columns == ["id", "score", "n"]
    with pytest.raises(Invalid):
        ranking.fuse([ranking.order_by(rows, "n")])


def test_kmeans_finds_three_centres():
    rows = np.array([(x + i * 0.01, y + i * 0.01) for x, y in ((10, 0), (0, 10), (-10, 0)) for i in range(10)])
    centroids = ivf.kmeans(rows, 3, "l2", 20)
    assert sorted(np.bincount(ivf.nearest(rows, centroids, "l2"))) == [10, 10, 10]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_index_against_exact(spark, tmp_path, metric):
    r = random.Random(4)
    centres = [[r.uniform(-5, 5) for _ in range(16)] for _ in range(12)]
    data = [(i, [c + r.uniform(-0.25, 0.25) for c in centres[i % 12]], "rare" if i % 40 == 0 else "common") for i in range(600)]
    frame = spark.createDataFrame(data, "id long, vector array<float>, tier string")
    index = ivf.IvfIndex.build(frame, str(tmp_path / "ivf"), metric)
    index = ivf.IvfIndex.load(spark, index.path)
    hits = 0
    for q in (3, 77, 410):
        exact = ids(ranking.knn(frame, data[q][1], 10, metric))
        assert ids(index.search(spark, data[q][1], 10, nprobe=len(index.centroids))) == exact
        hits += len(set(exact) & set(ids(index.search(spark, data[q][1], 10))))
    assert hits >= 27
    rare = ["tier", "Eq", "rare"]
    assert ids(index.search(spark, data[3][1], 10, 1, rare)) == ids(ranking.knn(frame, data[3][1], 10, metric, rare))


def test_default_probes_reach_recall_without_clusters(spark, tmp_path):
    """Vectors of pure noise, for which eight clusters of 32 hold too few of the neighbours."""
    r = np.random.default_rng(5)
    data = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(1000, 32)))]
    frame = spark.createDataFrame(data, "id long, vector array<float>")
    index = ivf.IvfIndex.load(spark, ivf.IvfIndex.build(frame, str(tmp_path / "noise")).path)
    shares = []
    for q in range(0, 1000, 100):
        exact = set(ids(ranking.knn(frame, data[q][1], 20)))
        shares.append(len(exact & set(ids(index.search(spark, data[q][1], 20)))) / 20)
    assert sum(shares) / len(shares) >= 0.9 and index.nprobe < len(index.centroids)


def test_recall(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2, 3, 4], [2, 3, 9]))
    assert ranking.recall(a, b).first()[0] == 0.5 and ranking.recall(a.filter("false"), b).first()[0] == 1.0
