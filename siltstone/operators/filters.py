"""The filter language, compiled to one Boolean column.

A filter is [attribute, operator, value], or ["And" | "Or", [filters]], or ["Not", filter]. Evaluation has two truth
values: what is negated is first made total, so negations hold on missing values. Everything else stays a plain
comparison, where null means no match anyway and which Parquet scans take as pushed filters.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..functions import patterns, text, values
from ..schema import Schema

NEGATIONS = {
    "NotEq": "Eq",
    "NotIn": "In",
    "NotContains": "Contains",
    "NotContainsAny": "ContainsAny",
    "NotGlob": "Glob",
    "NotIGlob": "IGlob",
    "NotRegex": "Regex",
}
ORDERING = ("Gt", "Gte", "Lt", "Lte")
FULL_TEXT = ("ContainsAllTokens", "NotContainsAllTokens", "ContainsTokenSequence", "Fuzzy")
PATTERN = ("Glob", "IGlob", "Regex")
OPERATORS = {"Eq", "In", "Contains", "ContainsAny", *NEGATIONS, *ORDERING, *FULL_TEXT, *PATTERN}


def parse(raw: Any) -> tuple:
    """("leaf", attribute, operator, value), ("And" | "Or", [..]) or ("Not", ..)."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise Invalid("a filter must be a JSON array") from e
    if not isinstance(raw, (list, tuple)) or not raw:
        raise Invalid(f"a filter must be a non-empty array, not {raw!r}")
    if len(raw) == 3:  # always a comparison: an attribute may be called "And"
        key, op, value = raw
        if not isinstance(key, str) or not isinstance(op, str):
            raise Invalid("a comparison is [attribute, operator, value]")
        if op not in OPERATORS:
            raise Invalid(f"unknown operator {op!r}")
        if isinstance(value, float) and value != value:
            raise Invalid(f"filter on {key!r}: not a number")
        return "leaf", key, op, value
    if len(raw) == 2 and raw[0] in ("And", "Or"):
        if not isinstance(raw[1], (list, tuple)) or not raw[1]:
            raise Invalid(f"{raw[0]} needs a list of at least one filter")
        return raw[0], [parse(f) for f in raw[1]]
    if len(raw) == 2 and raw[0] == "Not":
        return "Not", parse(raw[1])
    raise Invalid(f"not a filter: {raw!r}")


def attributes(tree: tuple) -> set[str]:
    if tree[0] == "leaf":
        return {tree[1]}
    return attributes(tree[1]) if tree[0] == "Not" else set().union(*map(attributes, tree[1]))


class FilterCompiler:
    """Compiles filters against a schema."""

    def __init__(self, schema: Schema):
        self.schema = schema

    def compile(self, raw: Any, total: bool = False) -> Column:
        """A condition for filter(); its null means no match. total gives false instead, for use as a value."""
        found = self._tree(parse(raw))
        return _total(found) if total else found

    def _tree(self, tree: tuple) -> Column:
        if tree[0] == "leaf":
            return self._leaf(*tree[1:])
        if tree[0] == "Not":
            return ~_total(self._tree(tree[1]))
        found = self._tree(tree[1][0])
        for other in tree[1][1:]:
            found = found & self._tree(other) if tree[0] == "And" else found | self._tree(other)
        return found

    def _leaf(self, key: str, op: str, raw: Any) -> Column:
        kind = self.schema.types.get(key)
        if key == "id":
            kind = self.schema.id_type or "uint"
        if op in NEGATIONS:
            return ~_total(self._positive(key, kind, NEGATIONS[op], raw))
        return self._positive(key, kind, op, raw)

    def _positive(self, key: str, kind: str | None, op: str, raw: Any) -> Column:
        never = F.lit(False)
        if op in FULL_TEXT:
            return self._full_text(key, kind, op, raw)
        if kind is None:  # unknown attributes are missing everywhere
            return F.lit(raw is None) if op in ("Eq", "In") else never
        column = F.col(f"`{key}`")
        if op in PATTERN:
            return self._pattern(column, kind, op, raw)
        if op in ("Eq", "In") and raw is None:
            return column.isNull()
        if raw is None:
            return never
        element = values.ELEMENT.get(kind, kind)
        if op in ("In", "ContainsAny"):
            return self._any_of(column, key, kind, op, raw, element)
        if op == "Contains":
            if kind in values.ELEMENT:
                return F.array_contains(column, literal(self.coerced(key, raw, element), element))
            value = self.coerced(key, raw, kind)
            if kind not in values.TEXTUAL:
                return never
            return _rendered(column, kind).contains(F.lit(_rendered_value(value)))
        value = self.coerced(key, raw, kind)
        if kind == "sparse":
            if op == "Eq":
                raise Invalid(f"filter on {key!r}: sparse vectors cannot be compared")
            return never
        wanted = literal(value, kind)
        if op == "Eq":
            return column == wanted
        return {"Gt": column > wanted, "Gte": column >= wanted, "Lt": column < wanted, "Lte": column <= wanted}[op]

    def _any_of(self, column: Column, key: str, kind: str, op: str, raw: Any, element: str) -> Column:
        items = raw if isinstance(raw, (list, tuple)) else [raw]
        if any(x is None for x in items):
            raise Invalid(f"filter on {key!r}: a list of values cannot hold null")
        found = [self.coerced(key, x, element) for x in items]
        if not found or kind == "sparse":
            return F.lit(False)
        if kind in values.ELEMENT:
            if op == "In":
                return F.lit(False)
            return F.arrays_overlap(column, F.array(*[literal(x, element) for x in found]))
        return column.isin(*[literal(x, kind) for x in found])

    def _pattern(self, column: Column, kind: str, op: str, raw: Any) -> Column:
        if kind not in values.TEXTUAL or not isinstance(raw, str):
            return F.lit(False)
        found = patterns.java_regex(raw) if op == "Regex" else patterns.glob_to_regex(raw, op == "IGlob")
        return F.lit(False) if found is None else _rendered(column, kind).rlike(found)

    def _full_text(self, key: str, kind: str | None, op: str, raw: Any) -> Column:
        config = self.schema.text.get(key) or text.TextConfig()
        wanted = text.tokenize(raw, config) if isinstance(raw, str) else []
        if kind not in ("string", "[]string") or not wanted:
            return F.lit(False)
        held = text.tokens(text.joined(F.col(f"`{key}`"), kind), config)
        return token_match(held, op, wanted)

    def coerced(self, key: str, raw: Any, kind: str) -> Any:
        try:
            return values.coerce(raw, kind)
        except Invalid as e:
            raise Invalid(f"filter on {key!r}: {e}") from e


def token_match(held: Column, op: str, wanted: list[str]) -> Column:
    """A full-text operator over an array of tokens."""
    if op == "ContainsTokenSequence":
        line = F.concat(F.lit(" "), F.array_join(held, " "), F.lit(" "))
        return line.contains(" " + " ".join(wanted) + " ")
    if op == "Fuzzy":
        every = None
        for w in dict.fromkeys(wanted):
            near = _near(held, w, 0 if len(w) <= 5 else 1)
            every = near if every is None else every & near
        return every
    has_all = F.size(F.array_intersect(held, F.array(*[F.lit(w) for w in dict.fromkeys(wanted)]))) == len(set(wanted))
    if op == "NotContainsAllTokens":  # no plain negation: missing text does not match either
        return held.isNotNull() & ~_total(has_all)
    return held.isNotNull() & has_all


def _near(held: Column, word: str, budget: int) -> Column:
    return F.exists(held, lambda t: F.levenshtein(t, F.lit(word), budget) >= 0)


def _total(predicate: Column) -> Column:
    """False for null."""
    return F.coalesce(predicate, F.lit(False))


def literal(value: Any, kind: str) -> Column:
    """A coerced value as a column of its kind."""
    if kind == "datetime":
        return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())
    if kind in values.ELEMENT:
        inner = values.SPARK[values.ELEMENT[kind]]
        return F.array(*[F.lit(x).cast(inner) for x in value]).cast(values.SPARK[kind])
    return F.lit(value).cast(values.SPARK[kind])


def _rendered(column: Column, kind: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'") if kind == "datetime" else column


def _rendered_value(value: Any) -> str:
    return values.format_datetime(value) if hasattr(value, "strftime") else str(value)


def apply(frame: DataFrame, raw: Any, schema: Schema | None = None) -> DataFrame:
    """The rows that a filter keeps; no filter keeps all."""
    if raw is None:
        return frame
    return frame.filter(FilterCompiler(schema or Schema.of(frame)).compile(raw))
