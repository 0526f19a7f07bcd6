"""Aggregations over all rows that a filter keeps, grouped or not."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid
from ..schema import Schema

FUNCTIONS = ("Count", "Sum", "Min", "Max", "Avg")
MICROS_TO_NANOS = 1000


def parse(spec: dict[str, Any]) -> dict[str, tuple[str, str | None]]:
    """{label: (function, attribute)} from {label: ["Count"] or [function, attribute]}."""
    if not isinstance(spec, dict) or not spec:
        raise Invalid("aggregate_by must name at least one aggregate")
    found = {}
    for label, raw in spec.items():
        if not isinstance(raw, (list, tuple)) or not raw or not all(isinstance(x, str) for x in raw):
            raise Invalid(f"aggregate {label!r} must be a list of names")
        function, *args = raw
        if function not in FUNCTIONS:
            raise Invalid(f"aggregate function {function!r} is not known")
        if len(args) > 1 or not args and function != "Count":
            raise Invalid(f"{function} takes one attribute")
        found[label] = function, args[0] if args else None
    return found


def parse_groups(spec: list[Any] | None) -> list[tuple[str, bool]]:
    """[(attribute, each element)] from attribute names and ["ForEachUnique", attribute]."""
    found = []
    for raw in spec or []:
        if isinstance(raw, str):
            found.append((raw, False))
        elif isinstance(raw, (list, tuple)) and len(raw) == 2 and raw[0] == "ForEachUnique" and isinstance(raw[1], str):
            found.append((raw[1], True))
        else:
            raise Invalid(f"not a group key: {raw!r}")
    return found


def _expression(function: str, attribute: str | None, schema: Schema) -> Column:
    if attribute is None:
        return F.count(F.lit(1))
    kind = schema.types.get(attribute)
    if kind is None:  # an attribute nobody has
        return {"Count": F.lit(0).cast("long"), "Sum": F.lit(0).cast("long")}.get(function, F.lit(None))
    column = F.col(f"`{attribute}`")
    if function == "Count":
        return F.count(column)
    if function in ("Min", "Max"):
        if kind == "sparse":
            raise Invalid(f"{function} of {attribute!r}: sparse vectors have no order")
        return F.min(column) if function == "Min" else F.max(column)
    if kind == "datetime":
        column = F.unix_micros(column.cast("timestamp")) * MICROS_TO_NANOS
    elif kind not in ("int", "uint", "float"):
        raise Invalid(f"{function} of {attribute!r}: not a number")
    if function == "Avg":
        return F.avg(column)
    return F.coalesce(F.sum(column), F.lit(0) if kind != "float" else F.lit(0.0))


def aggregate(frame: DataFrame, aggregate_by: dict[str, Any], group_by: list[Any] | None = None, schema: Schema | None = None, order: bool = True) -> DataFrame:
    """One row, or one for each combination of group keys, ordered by the keys with the null group first.

    Sum of nothing is 0, the others null. An array under ForEachUnique gives a group for each distinct element, and
    the null group if it is empty or missing. A label that is also a key wins.
    """
    schema = schema or Schema.of(frame)
    specs = parse(aggregate_by)
    keys = parse_groups(group_by)
    columns = {label: _expression(f, a, schema) for label, (f, a) in specs.items()}
    if not keys:
        return frame.agg(*[c.alias(label) for label, c in columns.items()])
    needed = {a for _, a in specs.values() if a in schema.types}
    held = frame.select(*[F.col(f"`{c}`") for c in sorted(needed)], *[_key(a, schema).alias(f"__key{i}") for i, (a, _) in enumerate(keys)])
    for i, (a, each) in enumerate(keys):
        if each and schema.types.get(a, "").startswith("[]"):
            held = held.withColumn(f"__key{i}", F.explode_outer(F.array_distinct(f"__key{i}")))
    names = [f"__key{i}" for i in range(len(keys))]
    out = held.groupBy(*names).agg(*[c.alias(f"__agg{i}") for i, c in enumerate(columns.values())])
    if order:
        out = out.orderBy(*[F.col(n).asc_nulls_first() for n in names])
    own = {a: F.col(n) for (a, _), n in zip(keys, names, strict=True)} | {label: F.col(f"__agg{i}") for i, label in enumerate(columns)}
    return out.select(*[c.alias(n) for n, c in own.items()])


def _key(attribute: str, schema: Schema) -> Column:
    return F.col(f"`{attribute}`") if attribute in schema.types else F.lit(None).cast("string")
