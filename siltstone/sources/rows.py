"""Rows from JSON: one object a row, or one list a column."""

from __future__ import annotations

from typing import Any

from ..errors import Invalid


def from_columns(columns: dict[str, list[Any]]) -> list[dict[str, Any]]:
    """Rows from equally long lists; a null cell is no value."""
    if not isinstance(columns, dict) or "id" not in columns:
        raise Invalid("column writes need an id column")
    n = len(columns["id"])
    for name, values in columns.items():
        if len(values) != n:
            raise Invalid(f"column {name!r} has {len(values)} values, id has {n}")
    names = list(columns)
    return [{k: v for k, v in zip(names, cells, strict=True) if v is not None or k == "id"} for cells in zip(*columns.values(), strict=True)]


def checked(rows: Any) -> list[dict[str, Any]]:
    if not isinstance(rows, list) or not all(isinstance(r, dict) and "id" in r for r in rows):
        raise Invalid("rows must be a list of objects that have an id")
    return rows
