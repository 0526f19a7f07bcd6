"""The other corpus operators on small fixtures, with edge rows and against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe, decontaminate, exact, packing, sharding, token_files, toxicity
from siltstone.llm.elias_fano import EliasFano, encode
from siltstone.llm.scratch import fresh_path

TEXTS = ["", None, "a", "Hello, world! It's 2024.", "naïve café — déjà vu\n\n\tx", "word " * 3000, "日本語 テキスト", " lead", "<|endoftext|> mid"]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 5, t, "clash") for i, t in enumerate(TEXTS)] + [(100, "same row", "q"), (100, "same row", "q")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def ids_of(text):
    found = Tokenizer.from_file(bpe.default_path()).encode(text or "", add_special_tokens=False).ids + [0]
    return np.array(found, "<u4")


def test_elias_fano():
    r = random.Random(1)
    for values in ([], [0], [5, 5, 5], sorted(r.randrange(1 << 40) for _ in range(3000)), list(range(0, 90000, 7)), [0] * 600 + [1 << 62]):
        found = EliasFano(encode(np.array(values, np.uint64)))
        assert len(found) == len(values) and found.slice(0, len(values)).tolist() == values
        assert all(found.select(i) == values[i] for i in range(0, len(values), 37))


def test_token_files_round_trip(spark, docs):
    folder = fresh_path(spark, "test-tokens")
    got = [tuple(r) for r in token_files.read(token_files.write(docs, folder), folder).orderBy("start").collect()]
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = ids_of(r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = docs.filter("false")
    assert token_files.read(token_files.write(empty, fresh_path(spark, "none")), folder).count() == 0


def test_packing(docs):
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for d in docs.collect():
        ids = ids_of(d.text)
        mine = sorted(by_doc[(d.doc_id, len(ids))], key=lambda r: r.start)
        copies = 2 if d.doc_id == 100 else 1
        assert sum(r.length for r in mine) == copies * len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    assert packing.pack(docs.filter("false")).count() == 0


def test_exact(spark):
    rows = [(1, "a b", "x"), (2, "a  b ", "x"), (3, "ab", "x"), (4, None, "x"), (5, " \n", "x"), (6, "c", "x"), (None, "c", "x"), (7, "ac", "x"), (7, "ac", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.equal_text_groups(frame, hash_all=True).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False), (4, 5, 2, False), (5, 5, 2, True), (6, None, 2, False), (None, None, 2, True), (7, 7, 2, True)}
    kept = exact.drop_copies(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {2, 5, None, 7}
    assert exact.equal_text_groups(frame.filter("false")).count() == 0


def test_exact_white_space_variants_under_one_id(spark):
    rows = [(None, "a b"), (None, "ab"), (None, "c"), (5, "d  e"), (5, "de"), (5, "de"), (6, "f g"), (6, "f\tg"), (7, "h i"), (7, "h i"), (8, ""), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in exact.drop_copies(frame).collect())
    tabs = [kept.pop((6, t), 0) for t in ("f g", "f\tg")]
    assert kept == Counter({(None, "a b"): 1, (None, "c"): 1, (5, "d  e"): 1, (7, "h i"): 2, (8, ""): 1, (8, None): 1}) and sorted(tabs) == [0, 1]


def test_decontamination(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 30)))) for i in range(12)] + [(50, ""), (51, "two words")]
    docs = []
    for i in range(60):
        body = [r.choice(vocabulary) for _ in range(60)]
        if i % 3 == 0:
            planted = items[r.randrange(12)][1].split()
            if i % 2:
                planted[r.randrange(len(planted))] = "changed"
            body[20:20] = planted
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, "so two words here")]

    def shingles(t):
        return Counter(" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4)))

    want = set()
    for d, text in docs:
        t = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            q = item.split()
            for s in range(len(t) - len(q) + 1) if q else ():
                if decontaminate.similarity(shingles(t[s : s + len(q)]), shingles(q)) >= 0.8:
                    want.add((d, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame, bench).collect()} == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame, bench, block_bytes=200).collect()} == want
    assert decontaminate.contaminated(frame, bench.filter("false")).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(words[:i])) for i in range(51)] + [(100, " ".join(words[3:48])), (101, " ".join(words[:30] + ["x"] + words[31:45])), (102, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2 w3")], "item_id long, text string")

    def shingles(t):
        return Counter(" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4)))

    want = {d for d, t in docs if decontaminate.similarity(shingles((t or "").split()), shingles(words)) >= 0.8}
    got = [x for x in decontaminate.contaminated(frame, bench).collect() if x.item_id == 1]
    assert {x.doc_id for x in got} == want >= {45, 50, 100} and 20 not in want
    assert {(x.start, x.n_words) for x in got if x.doc_id == 45} == {(0, 45)}


def test_sharding(spark, tmp_path):
    rows = [(i, f"t{i}" if i % 7 else None) for i in range(3000)] + [(5, "again"), (None, "q")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op1_hash_tree_shards(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"} and {r.shard for r in out} <= set(range(16))
    for shard in range(16):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    assert 0 < sum(r.grown_shard == 16 for r in out) < len(out) / 8


def test_toxicity(spark):
    r = random.Random(5)
    calm = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    bad = ["".join(r.choice("stuvwxyz") for _ in range(6)) for _ in range(20)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [r.choice(calm) for _ in range(60)]
        if toxic:
            words[10:10] = [r.choice(bad) for _ in range(12)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    out = {x.doc_id: x for x in toxicity.classify(frame, model).collect()}
    assert len(out) == 402 and all(0 <= x.score <= 1 for x in out.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in out if out[i].held_out} >= set(held)
    assert sum(out[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert out[1000].predicted == out[1001].predicted == 0
