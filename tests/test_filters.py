import pytest
from pyspark.sql import functions as F

from siltstone.errors import Invalid
from siltstone.functions import patterns
from siltstone.operators import filters
from siltstone.schema import Schema


@pytest.fixture(scope="module")
def record(spark):
    rows = [("acme", 12, True, "2024-03-05", ["red", "blue"], "docs/intro.md", None)]
    frame = spark.createDataFrame(rows, "tenant string, count long, public boolean, when string, tags array<string>, path string, absent long")
    return frame.withColumn("when", F.col("when").cast("timestamp_ntz"))


CASES = [
    (["tenant", "Eq", "acme"], True), (["tenant", "Eq", "globex"], False), (["tenant", "NotEq", "globex"], True),
    (["tenant", "In", ["acme", "x"]], True), (["tenant", "NotIn", ["x"]], True), (["tenant", "In", []], False),
    (["tags", "Contains", "red"], True), (["tags", "Contains", "green"], False), (["path", "Contains", "intro"], True),
    (["tags", "ContainsAny", ["green", "blue"]], True), (["tags", "NotContainsAny", ["green"]], True), (["tags", "In", ["red"]], False),
    (["count", "Gte", 12], True), (["count", "Gt", 11], True), (["count", "Gt", 12], False), (["count", "Lte", 12], True), (["count", "Lt", 13], True),
    (["when", "Gte", "2024-03-01"], True), (["when", "Lt", "2024-03-01"], False), (["when", "In", ["2024-03-05"]], True),
    (["when", "Glob", "2024-03-05T*"], True),
    *[(["absent", op, 5], False) for op in ("Gt", "Gte", "Lt", "Lte", "Eq")], (["absent", "NotEq", 5], True), (["absent", "Eq", None], True),
    (["absent", "In", None], True), (["tenant", "NotEq", None], True),
    (["path", "Glob", "docs/*"], True), (["path", "Glob", "docs/intro?md"], True), (["path", "Glob", "docs/*.txt"], False), (["path", "Glob", "docs"], False),
    (["path", "Glob", "DOCS/*"], False), (["path", "IGlob", "DOCS/*"], True), (["path", "NotGlob", "other/*"], True), (["path", "NotIGlob", "DOCS/*"], False),
    (["path", "Regex", "^docs/"], True), (["path", "Regex", r"\.md$"], True), (["path", "NotRegex", "^other/"], True),
    (["path", "Regex", "[unclosed"], False), (["path", "NotRegex", "[unclosed"], True), (["path", "Regex", "(?=d)"], False), (["path", "Regex", r"(d)\1"], False),
    (["And", [["tenant", "Eq", "acme"], ["Or", [["count", "Lt", 5], ["public", "Eq", True]]]]], True),
    (["Not", ["And", [["tenant", "Eq", "acme"], ["absent", "Gt", 1]]]], True), (["Not", ["absent", "Gt", 1]], True),
    (["nowhere", "Eq", 1], False), (["nowhere", "NotEq", 1], True), (["nowhere", "Glob", "*"], False), (["nowhere", "Eq", None], True),
    (["tenant", "ContainsAllTokens", ""], False), (["nowhere", "NotContainsAllTokens", "x"], False), (["tenant", "NotContainsAllTokens", "x"], True),
    (["path", "ContainsTokenSequence", "docs intro"], True), (["path", "ContainsTokenSequence", "intro docs"], False),
]


def test_one_record(record):
    compiler = filters.FilterCompiler(Schema.of(record))
    row = record.select(*[compiler.compile(f, total=True).alias(str(i)) for i, (f, _) in enumerate(CASES)]).first()
    wrong = [(f, row[str(i)]) for i, (f, want) in enumerate(CASES) if row[str(i)] != want]
    assert not wrong


@pytest.mark.parametrize(
    "raw",
    ["x", [], ["And"], ["And", []], ["Or", "x"], ["Not"], ["a", "Frobnicate", 1], [1, "Eq", 2], {"And": []}, ["And", [["a", "Eq"]]]],
)
def test_rejected(raw):
    with pytest.raises(Invalid):
        filters.parse(raw)


def test_an_attribute_may_be_called_and():
    assert filters.parse(["And", "Eq", "x"]) == ("leaf", "And", "Eq", "x")


@pytest.mark.parametrize("raw", [["count", "Gte", "12"], ["tenant", "Gt", 1], ["when", "Lt", "soon"], ["count", "In", ["x"]]])
def test_literals_that_do_not_fit_name_the_attribute(record, raw):
    with pytest.raises(Invalid, match=raw[0]):
        filters.apply(record, raw)


def test_comparisons_are_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as n", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    found = filters.apply(frame, ["And", [["n", "Gte", 3], ["s", "In", ["5", "6"]]]])
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,3)" in plan and "In(s" in plan


def test_glob_takes_everything_else_literally():
    assert patterns.glob_to_regex("a.b*") == r"\Aa\.b[^\n]*\z"
