"""Every stage and operator on null and empty values, repeated rows, clashing columns, a long text and an empty table."""

import random
import time
import zlib

import pytest

import corpus_pipeline
from siltstone.llm import pii, registry, token_files, toxicity
from siltstone.llm.scratch import fresh_path

R = random.Random(21)
CLASH = ["own", "h", "g", "a", "th", "starts", "text_sha256", "fp", "label", "draw", "bucket", "mark", "keep", "same", "first", "copy", "__lost", "__own", "__text", "kept", "size", "n"]
BAD = ["vobuxel", "vobuxing", "kratzim", "kratzor"]


VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(600)]


def prose(n):
    return " ".join(R.choices(VOCABULARY, k=n))


TOXIC = [(100 + i, prose(20) + " " + " ".join(R.choices(BAD, k=6)) + " " + prose(20)) for i in range(60)]
CALM = [(300 + i, prose(60)) for i in range(240)]
ITEM = prose(25)
ROWS = [(None, None), (None, ""), (1, None), (2, " \n"), (3, prose(80)), (4, ITEM + " " + prose(40)), (5, prose(40_000))]
ROWS += [ROWS[4], ROWS[4], (6, ROWS[4][1]), (7, ROWS[4][1].replace(" ", "  ", 1)), (8, ROWS[4][1].upper()), (None, "x y"), (None, prose(30))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    rows = [(i, t, "en", "s", None if t is None else len(t), *range(len(CLASH))) for i, t in ROWS + TOXIC + CALM]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASH)
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/full/documents.parquet")
    spark.createDataFrame([], kind).write.parquet(f"{folder}/empty/documents.parquet")
    for name in ("full", "empty"):
        items = [(1, ITEM), (2, None), (3, "")] if name == "full" else []
        known = [(i, int(i < 300)) for i, _ in TOXIC + CALM] + [(None, 1), (5, None)] if name == "full" else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
        spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
    return str(folder)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    went = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{folder}/full")
        assert out.columns == docs.columns
        before, after = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in (docs, out))
        assert set(after) <= set(before)
        went[name] = set(before) - set(after)
        if name == "exact_dedup":  # a repeated row is one document, and stays whole
            assert sorted(map(str, after)) == sorted(str(r) for r in before if r in set(after))
        docs = spark.createDataFrame(out.collect(), out.schema)
    marked = {i for i, t in TOXIC}
    assert {i for i, _ in went["toxicity"]} <= marked and len(went["toxicity"]) >= 55
    longest = (7, next(t for i, t in ROWS if i == 7))
    assert {(3, ROWS[4][1]), (6, ROWS[4][1])} <= went["exact_dedup"] and longest not in went["exact_dedup"]
    assert {i for i, _ in went["near_dedup"]} >= {8} and {i for i, _ in went["decontamination"]} == {4}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"{folder}/full")
    assert packed.count() >= docs.count() and packed.filter("length > 1024 or offset <> 0").count() == 0


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{folder}/full")
    assert sorted(map(str, corpus_pipeline.run(spark, f"{folder}/full").collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_row_has_a_result(spark, folder, name):
    out = registry.QUERIES[name](spark, f"{folder}/full")
    rows = out.collect()
    if name.startswith("op5"):
        assert {(r.doc_id, r.item_id) for r in rows} == {(4, 1)}
    elif name.startswith("op10"):
        assert sum(r.start == 0 for r in rows) == len(ROWS + TOXIC + CALM)
    else:
        assert len(rows) == len(ROWS + TOXIC + CALM)
    assert registry.QUERIES[name](spark, f"{folder}/empty").count() == 0


def test_pipeline_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_digit_runs_are_linear():
    def seconds(n):
        start = time.process_time()
        pii.find("7" * n + " " + "1." * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(400_000) < 40 * max(seconds(20_000), 0.01)


def test_toxicity_without_both_classes(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    known = spark.createDataFrame([(i, 1) for i, _ in TOXIC], "doc_id long, toxic int")
    out = toxicity.classify(docs, toxicity.fit(docs, known)).collect()
    assert {r.score for r in out} == {0.0} and {r.held_out for r in out} == {True, False}


def test_toxicity_scores_held_out_rows_and_repeats_alike(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/full/labels.parquet"))
    assert model.toxic and model.ordinary
    out = toxicity.classify(docs, model).collect()
    held = [r for r in out if r.doc_id is not None and 100 <= r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id < 300) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in out if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in out)


def test_token_files_order_repeated_ids(spark):
    texts = [prose(12) for _ in range(40)]
    frame = spark.createDataFrame([(1, t) for t in texts] + [(None, t) for t in texts[:7]], "doc_id long, text string")
    runs = []
    for parts in (1, 5):
        where = fresh_path(spark, "tokens")
        found = token_files.read(token_files.write(frame.repartition(parts), where), where).collect()
        runs.append(sorted(map(str, found)))
    assert runs[0] == runs[1]
