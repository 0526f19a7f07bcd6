import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import stemmers, text
from siltstone.functions.text import TextConfig
from siltstone.operators import filters, ranking
from siltstone.schema import Schema

BODIES = ["the quick brown fox jumps over the lazy dog", "a quick brown dog", "the lazy dog sleeps all day", "foxes are quick and foxes are clever", "unrelated content about databases"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(BODIES)), "id long, body string")


@pytest.mark.parametrize(
    "raw,tokens",
    [("Running, jumps; FOXES!", ["run", "jump", "fox"]), ("the quick brown fox", ["quick", "brown", "fox"]), ("version 2 beta", ["version", "2", "beta"]), ("!!! ??? ...", []), ("classes", ["class"]), ("x" * 40, [])],
)
def test_english(spark, raw, tokens):
    assert text.tokenize(raw) == tokens
    assert spark.range(1).select(text.tokens(F.lit(raw)).alias("t")).first()["t"] == tokens


def test_folding_and_case(spark):
    assert text.tokenize("café naïve", TextConfig(stemming=False, ascii_folding=True)) == ["cafe", "naive"]
    assert text.tokenize("Fox", TextConfig(stemming=False, case_sensitive=True)) == ["Fox"]


@pytest.mark.parametrize(
    "word,stem",
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistently", "consist"), ("consolations", "consol"), ("knackeries", "knackeri"), ("knightly", "knight"),
        ("knots", "knot"), ("happy", "happi"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"),
        ("this", "this"), ("kiwis", "kiwi"), ("agreed", "agre"), ("relational", "relat"), ("rational", "ration"), ("skies", "sky"), ("dying", "die"), ("national", "nation"),
    ],
)
def test_porter2(word, stem):
    assert stemmers.english(word) == stem


@pytest.mark.parametrize(
    "language,word,stem",
    [
        ("german", "aufeinanderfolgenden", "aufeinanderfolg"), ("german", "häuser", "haus"), ("german", "kategorischen", "kategor"), ("swedish", "jaktkarlarne", "jaktkarl"), ("swedish", "klokheten", "klok"),
        ("norwegian", "havnemyndighetene", "havnemynd"), ("danish", "undersøgelsen", "undersøg"),
    ],
)
def test_other_languages(language, word, stem):
    assert stemmers.stemmer(language)(word) == stem


def test_indonesian():
    for pair in "bacaan=baca makanan=makan tulisan=tulis kerjakan=kerja rumahnya=rumah bukumu=buku pergilah=pergi apakah=apa bacalah=baca".split():
        word, stem = pair.split("=")
        assert stemmers.indonesian(word) == stem
    for word in "makan jalan bulan tahun ikan hujan pergi hati kali bagi isi api jari kepala sepatu dinding menari membaca berlari kelas bus".split():
        assert stemmers.indonesian(word) == word
    assert text.tokenize("Buku yang ada di rak ini dan itu", TextConfig(language="indonesian")) == ["buku", "rak"]


def ids(frame):
    return {r["id"] for r in frame.collect()}


def test_bm25(corpus):
    def find(q):
        return {r["id"]: r["score"] for r in ranking.bm25(corpus, "body", q).collect()}

    found = find("quick fox")
    assert {0, 3} <= set(found) and not {2, 4} & set(found)
    assert find("zebra") == find("the and of") == find("") == {}
    assert find("quick quick quick") == find("quick")
    assert max(find("sleeps").values()) > max(find("dog").values())


def test_bm25_of_no_rows(corpus):
    for none in (corpus.filter("false"), corpus.filter("id > 99"), corpus.withColumn("body", F.lit(None).cast("string"))):
        assert ranking.bm25(none, "body", "quick fox").collect() == []


def test_positions_of_terms(corpus):
    found = ranking.postings(corpus, "body", text.TextConfig(stemming=False)).collect()
    for row in corpus.collect():
        tokens = text.tokenize(row["body"] or "", text.TextConfig(stemming=False))
        own = {r["term"]: r["positions"] for r in found if r["id"] == row["id"]}
        assert own == {t: [i for i, x in enumerate(tokens) if x == t] for t in set(tokens)}
        assert all(r["tf"] == len(r["positions"]) and r["dl"] == len(tokens) for r in found if r["id"] == row["id"])


def test_positions_are_found_in_parts(monkeypatch):
    monkeypatch.setattr(text, "TOKENS_AT_ONCE", 3)
    lists = [["a", "b", "a"], None, [], ["c"] * 8, ["b", "a"], ["a"]]
    (found,) = text.positions.func(iter([pa.array(lists, pa.list_(pa.string()))]))
    want = [{t: [i for i, x in enumerate(own or []) if x == t] for t in own or []} for own in lists]
    assert [{e["term"]: e["positions"] for e in row} for row in found.to_pylist()] == want
    (none,) = text.positions.func(iter([pa.array([], pa.list_(pa.string()))]))
    assert len(none) == 0


@pytest.mark.parametrize(
    "op,query,want",
    [
        ("ContainsAllTokens", "quick dog", {0, 1}), ("ContainsAllTokens", "quick", {0, 1, 3}), ("ContainsAllTokens", "quick zebra", set()),
        ("ContainsTokenSequence", "quick brown", {0, 1}), ("ContainsTokenSequence", "brown quick", set()), ("ContainsTokenSequence", "quick dog", set()),
        ("ContainsTokenSequence", "quick brown fox", {0}), ("ContainsTokenSequence", "fox", {0, 3}), ("ContainsTokenSequence", "over the lazy", {0}),
        ("Fuzzy", "databses", {4}), ("Fuzzy", "databzzs", set()),
    ],
)
def test_token_filters(corpus, op, query, want):
    assert ids(filters.apply(corpus, ["body", op, query], Schema.of(corpus))) == want


def test_stems_pass_through_python_once_and_in_parts(corpus, monkeypatch):
    plan = ranking.postings(corpus, "body", text.TextConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    monkeypatch.setattr(text, "TOKENS_AT_ONCE", 3)
    lists = [["running", "dogs", "running"], None, [], ["x" * 50, "cats"], ["dogs"]]
    config = text.TextConfig(max_token_length=10)
    found = list(text._finished_positions(config).func(iter([pa.array(lists, pa.list_(pa.string()))])))
    assert len(found) > 1 and max(len(f) for f in found) < 5
    rows = [{e["term"]: e["positions"] for e in row} for f in found for row in f.to_pylist()]
    assert rows == [{"run": [0, 2], "dog": [1]}, {}, {}, {"cat": [0]}, {"dog": [0]}]
