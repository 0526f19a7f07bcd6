"""The stages of the pipeline on null and repeated ids."""

import random
from collections import Counter

import corpus_pipeline

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]


def prose(n=120):
    return " ".join(R.choice(WORDS) for _ in range(n))


def kept(spark, rows, stage, folder):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = stage(spark, frame, str(folder))
    assert out.columns == frame.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_near_copies_with_null_and_repeated_ids(spark, tmp_path):
    a, b, c, clean, other = (prose() for _ in range(5))
    A, B, C = a.upper(), b.upper(), c.upper()  # letter case takes no part in a fingerprint
    rows = [(1, a, "x"), (None, A, "x"), (None, clean, "x"), (None, b, "x"), (None, B, "x"), (7, c, "x"), (7, C, "x"), (7, other, "x"), (9, other.upper(), "x"), (None, clean, "x")]
    got = kept(spark, rows, corpus_pipeline.drop_near_copies, tmp_path)
    pairs = [got.pop((None, b), 0) + got.pop((None, B), 0), got.pop((7, c), 0) + got.pop((7, C), 0)]
    assert pairs == [1, 1] and got == Counter({(1, a): 1, (None, clean): 2, (7, other): 1})


def test_contaminated_with_null_and_repeated_ids(spark, tmp_path):
    item, clean, more = prose(30), prose(), prose()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = f"{prose(20)} {item} {prose(20)}"
    rows = [(None, bad, "x"), (None, clean, "x"), (None, None, "x"), (3, bad, "x"), (3, more, "x"), (3, more, "x")]
    assert kept(spark, rows, corpus_pipeline.drop_contaminated, tmp_path) == Counter({(None, clean): 1, (None, None): 1, (3, more): 2})
