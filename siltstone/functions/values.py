"""Attribute types, their coercions and how JSON values become typed values.

Types: bool, uint, int, float, string, datetime, uuid, []string, []uint, []int and sparse (a map from names to
weights). A missing value and null are the same. Unsigned numbers share Spark's BIGINT; datetimes are TIMESTAMP_NTZ
holding UTC.
"""

from __future__ import annotations

import uuid as _uuid
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import types as T

from ..errors import Invalid

SPARK = {
    "bool": T.BooleanType(),
    "uint": T.LongType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "uuid": T.StringType(),
    "[]string": T.ArrayType(T.StringType()),
    "[]uint": T.ArrayType(T.LongType()),
    "[]int": T.ArrayType(T.LongType()),
    "sparse": T.MapType(T.StringType(), T.FloatType()),
}
ELEMENT = {"[]string": "string", "[]uint": "uint", "[]int": "int"}
NUMERIC = {"uint", "int", "float"}
TEXTUAL = {"string", "uuid", "datetime"}
LARGEST = (1 << 63) - 1
_EPOCH = datetime(1970, 1, 1)


def type_of_spark(kind: T.DataType) -> str | None:
    """The attribute type that a Spark column holds; None where there is none."""
    if isinstance(kind, T.ArrayType):
        inner = type_of_spark(kind.elementType)
        return f"[]{inner}" if inner in ("string", "int", "uint") else None
    if isinstance(kind, T.MapType):
        return "sparse" if isinstance(kind.keyType, T.StringType) else None
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "datetime"
    return "string" if isinstance(kind, T.StringType) else None


def infer(raw: Any) -> str | None:
    """The type a JSON value declares; None for null and for an empty list, which declare nothing."""
    if raw is None or raw == []:
        return None
    if isinstance(raw, bool):
        return "bool"
    if isinstance(raw, int):
        if raw > LARGEST or raw < -LARGEST - 1:
            raise Invalid(f"{raw} does not fit in 64 bits")
        return "uint" if raw >= 0 else "int"
    if isinstance(raw, float):
        return "float"
    if isinstance(raw, datetime):
        return "datetime"
    if isinstance(raw, str):
        return "string"
    if isinstance(raw, dict):
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in raw.values()):
            raise Invalid("an object must map names to numbers")
        return "sparse"
    if isinstance(raw, (list, tuple)):
        kinds = {infer(x) for x in raw}
        if kinds == {"string"}:
            return "[]string"
        if kinds <= {"uint", "int"}:
            return "[]uint" if kinds == {"uint"} else "[]int"
        raise Invalid("a list must hold strings or whole numbers, all of one kind")
    raise Invalid(f"cannot store {type(raw).__name__}")


def parse_datetime(raw: str) -> datetime:
    """RFC 3339 with or without offset, or a bare date; the result is UTC without offset."""
    try:
        found = datetime.fromisoformat(raw)
    except ValueError as e:
        raise Invalid(f"{raw!r} is no datetime") from e
    return found.astimezone(UTC).replace(tzinfo=None) if found.tzinfo else found


def format_datetime(value: datetime) -> str:
    return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond:06d}000Z"


def coerce(raw: Any, kind: str) -> Any:
    """The value as the type wants it, or Invalid. Null fits anywhere."""
    if raw is None:
        return None
    if raw == [] and kind.startswith("[]"):
        return []
    have = infer(raw)
    if have == kind:
        return dict(raw) if kind == "sparse" else raw
    if have == "string" and kind == "uuid":
        try:
            return str(_uuid.UUID(raw))
        except ValueError as e:
            raise Invalid(f"{raw!r} is no uuid") from e
    if have == "string" and kind == "datetime":
        return parse_datetime(raw)
    if have == "uint" and kind == "datetime":
        return _EPOCH + timedelta(microseconds=raw // 1000)
    if have == "uint" and kind == "int" or have in ("uint", "int") and kind == "float":
        return float(raw) if kind == "float" else raw
    if have == "int" and kind == "uint" and raw >= 0:
        return raw
    if have == "[]uint" and kind == "[]int":
        return raw
    if have == "[]uint" and kind == "[]string":
        return [str(x) for x in raw]
    raise Invalid(f"cannot interpret {have or 'an empty list'} as {kind}")
