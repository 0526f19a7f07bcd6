import pytest

from siltstone.errors import Invalid
from siltstone.operators import aggregate

SCHEMA = "id long, color string, size string, price long, tags array<string>"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "red", "L", 10, ["a", "b"]), (2, "red", "L", 20, ["b"]), (3, "blue", "XL", 5, []), (4, None, "L", None, None)], SCHEMA)


def test_ungrouped(items):
    spec = {"n": ["Count"], "p": ["Count", "price"], "s": ["Sum", "price"], "lo": ["Min", "price"], "hi": ["Max", "price"], "a": ["Avg", "price"], "none": ["Sum", "nosuch"], "no": ["Min", "nosuch"]}
    row = aggregate.aggregate(items, spec).first().asDict()
    assert row.pop("a") == pytest.approx(35 / 3)
    assert row == {"n": 4, "p": 3, "s": 35, "lo": 5, "hi": 20, "none": 0, "no": None}


def test_no_rows(items):
    assert tuple(aggregate.aggregate(items.filter("false"), {"n": ["Count"], "s": ["Sum", "price"], "a": ["Avg", "price"]}).first()) == (0, 0, None)


def test_groups_come_in_order_with_null_first(items):
    got = [tuple(r) for r in aggregate.aggregate(items, {"n": ["Count"]}, ["color"]).collect()]
    assert got == [(None, 1), ("blue", 1), ("red", 2)]
    assert aggregate.aggregate(items, {"n": ["Count"]}, ["color", "size"]).count() == 3


def test_each_element_once(spark, items):
    got = {r[0]: r[1] for r in aggregate.aggregate(items, {"n": ["Count"]}, [["ForEachUnique", "tags"]]).collect()}
    assert got == {None: 2, "a": 1, "b": 2}
    twice = spark.createDataFrame([(1, "x", "L", 1, ["a", "a"])], SCHEMA)
    assert [tuple(r) for r in aggregate.aggregate(twice, {"n": ["Count"]}, [["ForEachUnique", "tags"]]).collect()] == [("a", 1)]


def test_a_label_wins_over_its_key(items):
    out = aggregate.aggregate(items, {"color": ["Count"]}, ["color"])
    assert out.columns == ["color"] and sorted(r[0] for r in out.collect()) == [1, 1, 2]


@pytest.mark.parametrize("bad", ["Count", [], ["Sum"], ["Frobnicate", "n"], ["Sum", "a", "b"], ["Sum", 5]])
def test_rejected(items, bad):
    with pytest.raises(Invalid):
        aggregate.aggregate(items, {"x": bad})


def test_sum_of_text_and_empty_spec_are_errors(items):
    for spec in ({"x": ["Sum", "color"]}, {}):
        with pytest.raises(Invalid):
            aggregate.aggregate(items, spec)
