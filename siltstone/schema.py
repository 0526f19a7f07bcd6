"""The schema of a collection: inferred from the first values, then enforced."""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import Invalid
from .functions import values
from .functions.text import TextConfig

METRICS = {"cosine_distance": "cosine", "euclidean_squared": "l2", "dot_product": "dot", "cosine": "cosine", "l2": "l2", "dot": "dot"}
NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")
RESERVED = {"id", "vector"}


@dataclass(frozen=True)
class Schema:
    types: dict[str, str] = field(default_factory=dict)
    text: dict[str, TextConfig] = field(default_factory=dict)
    embed: dict[str, str] = field(default_factory=dict)
    id_type: str | None = None
    dim: int | None = None
    metric: str = "cosine"
    shards: int = 1
    #: Data has been written, so metric and shards are fixed.
    started: bool = False

    @classmethod
    def of(cls, frame: DataFrame, **options) -> Schema:
        """What a frame's columns declare; the columns id and vector are no attributes."""
        found = {f.name: values.type_of_spark(f.dataType) for f in frame.schema if f.name not in RESERVED}
        return cls(types={k: v for k, v in found.items() if v}, started=True, **options)

    def declare(self, types=None, text=None, embed=None, metric=None, shards=None) -> Schema:
        """Add declarations. The same again is accepted, a change is not."""
        new = self
        if metric is not None:
            if metric not in METRICS:
                raise Invalid(f"unknown distance metric {metric!r}")
            if self.started and METRICS[metric] != self.metric:
                raise Invalid(f"the metric is {self.metric} and cannot change once data is written")
            new = replace(new, metric=METRICS[metric])
        for name, kind in (types or {}).items():
            if kind not in values.SPARK:
                raise Invalid(f"attribute {name!r}: unknown type {kind!r}")
            if new.types.get(name, kind) != kind:
                raise Invalid(f"attribute {name!r} is {new.types[name]} and cannot become {kind}")
            new = replace(new, types=new.types | {name: kind})
        for name, config in (text or {}).items():
            if new.types.get(name, "string") not in ("string", "[]string"):
                raise Invalid(f"attribute {name!r} is {new.types[name]}, and only text can be searched")
            if new.text.get(name, config) != config:
                raise Invalid(f"attribute {name!r} already has another text configuration")
            new = replace(new, text=new.text | {name: config})
        for name, model in (embed or {}).items():
            if new.embed.get(name, model) != model:
                raise Invalid(f"attribute {name!r} is already embedded by another model")
            new = replace(new, embed=new.embed | {name: model})
        if shards is not None and shards != self.shards:
            if not 1 <= shards <= 256:
                raise Invalid("shards must be between 1 and 256")
            if self.started:
                raise Invalid("shards can be set only by the first write")
            new = replace(new, shards=shards)
        return new

    def absorb(self, rows: list[dict[str, Any]]) -> tuple[Schema, list[dict[str, Any]]]:
        """Fix types from rows of id, vector and attributes, and return the rows with coerced values."""
        types, id_type, dim, out = dict(self.types), self.id_type, self.dim, []
        for row in rows:
            key, id_type = _identity(row.get("id"), id_type)
            new = {"id": key}
            vector = row.get("vector")
            if vector is not None:
                new["vector"], dim = _vector(vector, dim), dim or len(vector)
            for name, raw in row.items():
                if name in RESERVED:
                    continue
                kind = values.infer(raw)
                if raw is not None and name not in types and kind:
                    types[name] = kind
                try:
                    new[name] = values.coerce(raw, types[name]) if name in types else None
                except Invalid as e:
                    raise Invalid(f"attribute {name!r}: {e}") from e
            out.append(new)
        return replace(self, types=types, id_type=id_type, dim=dim, started=self.started or bool(rows)), out

    def struct(self) -> T.StructType:
        id_kind = T.LongType() if self.id_type in (None, "uint") else T.StringType()
        fields = [T.StructField("id", id_kind), T.StructField("vector", T.ArrayType(T.FloatType()))]
        return T.StructType(fields + [T.StructField(n, values.SPARK[k]) for n, k in sorted(self.types.items())])

    def to_json(self) -> dict[str, Any]:
        own = {k: getattr(self, k) for k in ("types", "embed", "id_type", "dim", "metric", "shards", "started")}
        return own | {"text": {k: v.to_json() for k, v in self.text.items()}}

    @classmethod
    def from_json(cls, raw: dict[str, Any]) -> Schema:
        return cls(**raw | {"text": {k: TextConfig(**v) for k, v in raw["text"].items()}})


def _identity(raw: Any, kind: str | None) -> tuple[Any, str]:
    if isinstance(raw, bool) or not isinstance(raw, (int, str)) or isinstance(raw, int) and not 0 <= raw <= values.LARGEST:
        raise Invalid(f"an id must be a number from 0 or a string, not {raw!r}")
    have = "uint" if isinstance(raw, int) else "string"
    if have == "string":
        try:
            parsed = str(uuid.UUID(raw))
            if kind != "string":
                return parsed, "uuid"
        except ValueError:
            pass
    if kind not in (None, have):
        raise Invalid(f"ids here are {kind}, not {have}")
    return raw, have


def _vector(raw: Any, dim: int | None) -> list[float]:
    if not raw or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in raw):
        raise Invalid("a vector must be a non-empty list of finite numbers")
    if dim is not None and len(raw) != dim:
        raise Invalid(f"vectors here have {dim} dimensions, not {len(raw)}")
    return [float(x) for x in raw]


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise Invalid(f"{name!r} is no valid name")
    return name
