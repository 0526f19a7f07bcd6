import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import TextConfig
from siltstone.operators import filters, inverted, ranking
from siltstone.schema import Schema
from siltstone.sources.collection import Collection

WORDS = "kelp wrack dulse laver carrageen sargassum".split()


def jars(many, seed=5):
    r = random.Random(seed)
    for i in range(many):
        label = None if i % 11 == 3 else " ".join(r.choices(WORDS, [40, 20, 10, 5, 2, 1], k=r.randint(0, 12)))
        salts = {w: r.choice([0.0, 0.5, 1.0, -2.0]) for w in r.sample(WORDS, r.randint(0, 4))}
        yield {"id": i, "label": label, "salts": salts, "shelf": i % 3}


@pytest.fixture(scope="module")
def shelves(spark, tmp_path_factory):
    """A collection with lists and nothing in its log."""
    box = Collection(spark, str(tmp_path_factory.mktemp("shelves")), "jars")
    kinds = {"label": {"type": "string", "full_text_search": {"stemming": False}}, "salts": "sparse"}
    box.write({"schema": kinds, "upsert_rows": list(jars(120))})
    box.compact()
    return box


def rounded(frame, *names):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select("id", "score", *names).collect()]


ASKED = [
    (["label", "BM25", "kelp sargassum"], {}),
    (["label", "BM25", "dulse"], {"filters": ["shelf", "Eq", 1]}),
    (["label", "BM25", "laver laver nori"], {"include_attributes": ["shelf"]}),
    (["label", "BM25", "the of"], {}),
    (["salts", "SparseKNN", {"kelp": 1.5, "laver": -1.0, "nori": 4}], {}),
    (["salts", "SparseKNN", {"dulse": 2}], {"filters": ["shelf", "NotEq", 0], "include_attributes": ["shelf"]}),
    (["salts", "SparseKNN", {}], {}),
    (["salts", "SparseKNN", {"wrack": 2}], {"filters": ["And", [["shelf", "Eq", 1], ["id", "Lt", 70]]], "include_attributes": ["shelf"]}),
]


FILTERS = [
    (["shelf", "Eq", 2], True),
    (["shelf", "In", [0, 2, 9]], True),
    (["marks", "Contains", "x"], True),
    (["marks", "ContainsAny", ["y", "z", "x"]], True),
    (["And", [["shelf", "Eq", 1], ["marks", "Contains", "y"]]], True),
    (["And", [["shelf", "Eq", 1], ["id", "Lt", 60]]], False),
    (["Or", [["shelf", "Eq", 1], ["fresh", "Eq", True]]], True),
    (["And", [["Or", [["shelf", "Eq", 1], ["marks", "Contains", "z"]]], ["fresh", "Eq", False]]], True),
    (["Or", [["shelf", "Eq", 1], ["id", "Lt", 5]]], None),
    (["shelf", "Eq", None], None),
    (["Not", ["shelf", "Eq", 1]], None),
    (["shelf", "NotIn", [1]], None),
    (["shelf", "Gt", 1], None),
    (["In", "Eq", 1], None),
]


def test_values_bound_filters(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, None if i % 9 == 4 else i % 3, None if i % 7 == 2 else r.choices("xyz", k=i % 4), [True, False, None][i % 5 % 3]) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, shelf long, marks array<string>, fresh boolean")
    schema = Schema.of(frame)
    lists = inverted.InvertedIndex.build(frame, str(tmp_path / "lists"), schema, 1 << 30)
    for asked, exact in FILTERS:
        found = lists.matching(spark, asked, schema)
        assert (found and found[1]) == exact, asked
        if found:
            ids, want = {x["id"] for x in found[0].collect()}, {x["id"] for x in filters.apply(frame, asked, schema).collect()}
            assert ids == want if exact else ids > want, asked


@pytest.mark.parametrize("rank,more", ASKED)
def test_lists_rank_like_a_scan(shelves, rank, more):
    found = shelves.query({"rank_by": rank, "top_k": 15, **more})
    assert found.plan["indexed"]
    common = dict(k=15, filter=more.get("filters"), include=more.get("include_attributes"), schema=shelves.manifest().schema)
    scan = ranking.bm25 if rank[1] == "BM25" else ranking.sparse
    assert rounded(found.rows, *more.get("include_attributes", [])) == rounded(scan(shelves.live(), rank[0], rank[2], **common), *more.get("include_attributes", []))


def test_later_writes_replace_what_is_listed(shelves):
    box = shelves.branch("later")
    box.write({"upsert_rows": [{"id": 500, "label": "nori kelp nori", "salts": {"nori": 9.0}, "shelf": 7}], "deletes": [0, 1, 2]})
    box.write({"patch_rows": [{"id": 5, "label": "kelp kelp kelp", "shelf": 8}]})
    before = shelves.query({"rank_by": ["label", "BM25", "kelp nori"], "top_k": 200}).rows
    after = box.query({"rank_by": ["label", "BM25", "kelp nori"], "top_k": 200, "include_attributes": ["shelf"]})
    old, new = {r["id"]: r["score"] for r in before.collect()}, {r["id"]: r for r in after.rows.collect()}
    assert after.plan["indexed"] and after.plan["tail_rows"] == 5
    assert not {0, 1, 2} & set(new) and new[500]["shelf"] == 7 and new[5]["shelf"] == 8
    # statistics are those of the lists: what was not touched scores as before, a term that they lack has the greatest weight
    assert all(new[i]["score"] == pytest.approx(s) for i, s in old.items() if i not in (0, 1, 2, 5)) and max(new, key=lambda i: new[i]["score"]) == 500
    live = box.live()
    got = rounded(box.query({"rank_by": ["salts", "SparseKNN", {"kelp": 1, "nori": 2}], "top_k": 50}).rows)
    assert got == rounded(ranking.sparse(live, "salts", {"kelp": 1, "nori": 2}, 50, schema=box.manifest().schema))
    box.compact()
    config = box.manifest().schema.text["label"]
    assert rounded(box.query({"rank_by": ["label", "BM25", "kelp nori"], "top_k": 200}).rows) == rounded(ranking.bm25(live, "label", "kelp nori", 200, config))


def test_only_the_buckets_of_the_query_are_read(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"word{i} common") for i in range(300)], "id long, body string")
    config = TextConfig(stemming=False)
    lists = inverted.InvertedIndex.build(frame, str(tmp_path / "lists"), Schema.of(frame, text={"body": config}), 5 << 30)
    assert lists.lists["body"]["buckets"] == 64
    rows = lists.entries(spark, "body", ["word7"])
    assert len(rows.inputFiles()) > 8
    read = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert rows.count() == 1 and len(read) == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+L? = \d+", plan), plan
    spread = {r["f"] for r in lists.entries(spark, "body", ["common"]).select(F.input_file_name().alias("f")).collect()}
    assert len(spread) > 3  # a frequent term fills many files


def test_nothing_to_list(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.5)], "id long, n double")
    assert inverted.InvertedIndex.build(frame, str(tmp_path / "none"), Schema.of(frame), 0) is None
    box = Collection(spark, str(tmp_path), "plain")
    box.write({"upsert_rows": [{"id": 1, "n": 2, "note": "kelp"}]})
    box.compact()
    assert not box.inverted().holds("note", TextConfig()) and [r["id"] for r in box.query({"rank_by": ["note", "BM25", "kelp"]}).rows.collect()] == [1]


def test_folding_a_large_log_changes_no_search(spark, tmp_path, monkeypatch):
    box = Collection(spark, str(tmp_path), "grown")
    rows = [{**row, "vector": [1.0, row["id"] / 10]} for row in jars(60)]
    box.write({"schema": {"label": {"type": "string", "full_text_search": {"stemming": False}}, "salts": "sparse"}, "upsert_rows": rows[:30]})
    box.compact()
    state = "label string, salts map<string, double>, shelf long, vector array<float>, id long, op string, pos int, touched array<string>"
    new = [(r["label"], r["salts"], 5, r["vector"], r["id"], "U", 0, None) for r in rows[25:50]] + [(None, None, None, None, 3, "D", 1, None)]
    asked = [
        {"rank_by": ["label", "BM25", "kelp laver"], "top_k": 60, "include_attributes": ["shelf"]},
        {"rank_by": ["label", "BM25", "kelp"], "top_k": 60, "filters": ["shelf", "Eq", 5]},
        {"rank_by": ["salts", "SparseKNN", {"kelp": 1.5, "laver": -1.0}], "top_k": 60},
        {"rank_by": ["vector", "ANN", [1.0, 2.0]], "top_k": 60, "nprobe": 50},
    ]
    small, large = box.branch("small"), box.branch("large")
    schema = box.manifest().schema
    small.append(spark.createDataFrame(new, state), schema)
    monkeypatch.setattr("siltstone.sources.collection.WRITE_LIMIT", 0)
    large.append(spark.createDataFrame(new, state), schema)
    monkeypatch.undo()
    assert len(small.manifest().log) == 1 and not large.manifest().log
    for _ in range(2):
        for request in asked:
            a, b = small.query(request), large.query(request)
            assert a.rows.collect() == b.rows.collect() and b.plan["indexed"] and a.plan == b.plan
        more = {"upsert_rows": [{"id": 70, "label": "kelp kelp", "shelf": 5, "vector": [0.0, 1.0]}], "deletes": [26]}
        small.write(more)
        large.write(more)
    large.gc(-1)
    assert large.query(asked[0]).rows.collect() == small.query(asked[0]).rows.collect()
    large.compact()
    assert not large.manifest().folded and large.metadata()["unindexed_bytes"] == 0


def test_lists_fill_as_many_files_as_their_entries_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "ENTRY_BYTES", 2048)
    frame = spark.createDataFrame([(i, f"word{i} common", {"a": 1.0, f"b{i}": 2.0}) for i in range(600)], "id long, body string, salts map<string, double>")
    lists = inverted.InvertedIndex.build(frame, str(tmp_path / "lists"), Schema.of(frame, text={"body": TextConfig(stemming=False)}), 1)
    for name, key in (("body", "common"), ("salts", "a")):
        assert lists.lists[name]["buckets"] > 4 and len(lists.entries(spark, name, [key]).inputFiles()) > 1
        assert lists.entries(spark, name, [key]).count() == 600
    assert not list(tmp_path.glob("**/*.loose"))
