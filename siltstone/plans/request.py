"""Query requests in JSON, checked and turned into DataFrames.

{rank_by, top_k | limit.total, filters, include_attributes, aggregate_by, group_by, consistency, nprobe}, or up to 16 of
them under queries, fused by rerank_by. rank_by is one of ["vector", "ANN" | "kNN", [..] or ["Embed", text]],
[attribute, "BM25", text], [attribute, "SparseKNN", {..}] and [attribute, "asc" | "desc"]. The native form with vector,
filter, order_by{}, text{} and sparse{} is understood too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import Invalid, Unsupported
from ..functions import vector
from ..functions.text import TextConfig
from ..operators import aggregate, filters, inverted, ivf, ranking
from ..schema import Schema

FIELDS = {"rank_by", "top_k", "limit", "filters", "include_attributes", "consistency", "vector_encoding", "queries", "rerank_by", "aggregate_by", "group_by", "nprobe"}
NATIVE = {"vector", "top_k", "filter", "nprobe", "consistency", "include_attributes", "order_by", "text", "sparse", "aggregate_by", "group_by"}
MOST_QUERIES = 16
EVENTUAL_SECONDS = 3600.0
RRF_K = 60.0


@dataclass
class Result:
    """Ranked rows, aggregates, and how the plan was chosen."""

    rows: DataFrame | None = None
    aggregations: DataFrame | None = None
    plan: dict[str, Any] = field(default_factory=dict)


@dataclass
class Tail:
    """What was written since the indexes were built: ids touched, their live rows, and the number of log entries."""

    changed: DataFrame
    rows: DataFrame
    entries: int


@dataclass
class Lists:
    """Inverted lists and the segment's rows that they are of."""

    index: inverted.InvertedIndex
    rows: DataFrame


@dataclass
class Query:
    kind: str | None  # ann, knn, bm25, sparse, order
    attribute: str = "vector"
    argument: Any = None
    top_k: int = ranking.DEFAULT_TOP_K
    filter: Any = None
    include: Any = None
    nprobe: int | None = None
    eventual_seconds: float = 0.0
    aggregate_by: dict[str, Any] | None = None
    group_by: list[Any] = field(default_factory=list)


def parse(raw: dict[str, Any], nested: bool = False) -> Query:
    if not isinstance(raw, dict):
        raise Invalid("a query is an object")
    if unknown := set(raw) - FIELDS:
        if raw.keys() <= NATIVE:
            return _native(raw)
        raise Invalid(f"unknown fields {sorted(unknown)}")
    if raw.get("vector_encoding") not in (None, "float"):
        raise Unsupported("only the vector encoding float is understood")
    if nested and raw.get("consistency") is not None:
        raise Invalid("consistency belongs to the outer query")
    include = _include(raw.get("include_attributes"))
    if raw.get("group_by") and raw.get("aggregate_by") is None:
        raise Invalid("group_by needs aggregate_by")
    if raw.get("aggregate_by") is not None:
        aggregate.parse(raw["aggregate_by"])
    aggregate.parse_groups(raw.get("group_by"))
    if raw.get("filters") is not None:
        filters.parse(raw["filters"])
    kind, attribute, argument = _rank_by(raw["rank_by"]) if raw.get("rank_by") is not None else (None, "", None)
    if kind is None and raw.get("aggregate_by") is None:
        raise Invalid("rank_by is required")
    total = (raw.get("limit") or {}).get("total") if isinstance(raw.get("limit"), dict) else None
    if raw.get("top_k") is not None and total is not None and raw["top_k"] != total:
        raise Invalid("top_k and limit.total disagree")
    top_k = raw["top_k"] if raw.get("top_k") is not None else total if total is not None else ranking.DEFAULT_TOP_K
    return Query(
        kind,
        attribute,
        argument,
        ranking.check_top_k(top_k),
        raw.get("filters"),
        include,
        ivf.check_nprobe(raw["nprobe"]) if "nprobe" in raw else None,
        _consistency(raw.get("consistency")),
        raw.get("aggregate_by"),
        raw.get("group_by") or [],
    )


def _include(raw: Any) -> Any:
    if raw is None or isinstance(raw, bool) or isinstance(raw, list) and all(isinstance(n, str) for n in raw):
        return raw
    raise Invalid("include_attributes is true, false or a list of names")


def _consistency(raw: Any) -> float:
    if raw is None:
        return 0.0
    level = raw.get("level", raw.get("mode")) if isinstance(raw, dict) else raw
    if level == "strong":
        return 0.0
    if level == "eventual":
        return raw["max_age_ms"] / 1000 if isinstance(raw, dict) and "max_age_ms" in raw else EVENTUAL_SECONDS
    raise Invalid(f"unknown consistency {raw!r}")


def _rank_by(raw: Any) -> tuple[str, str, Any]:
    if not isinstance(raw, list) or not 2 <= len(raw) <= 3 or not all(isinstance(x, str) for x in raw[:2]):
        raise Invalid("rank_by is [attribute, function, argument] or [attribute, direction]")
    attribute, function = raw[:2]
    if len(raw) == 2:
        if function not in ("asc", "desc"):
            raise Invalid(f"order is asc or desc, not {function!r}")
        return "order", attribute, function == "desc"
    argument = raw[2]
    if function in ("ANN", "kNN"):
        if attribute != "vector":
            raise Invalid("only the attribute vector can be searched by vector")
        return function.lower(), attribute, argument
    if function == "BM25":
        if not isinstance(argument, str):
            raise Invalid("BM25 takes a text")
        return "bm25", attribute, argument
    if function == "SparseKNN":
        if not isinstance(argument, dict):
            raise Invalid("SparseKNN takes an object of weights")
        return "sparse", attribute, argument
    raise Unsupported(f"rank_by function {function!r} is not known")


def _native(raw: dict[str, Any]) -> Query:
    """Precedence if several rankings are given: order_by, sparse, text, vector."""
    own = {k: raw.get(k) for k in ("top_k", "include_attributes", "consistency", "aggregate_by", "group_by", "nprobe") if raw.get(k) is not None}
    if raw.get("order_by"):
        rank = [raw["order_by"]["attribute"], "desc" if raw["order_by"].get("descending") else "asc"]
    elif raw.get("sparse"):
        rank = [raw["sparse"]["attribute"], "SparseKNN", raw["sparse"]["vector"]]
    elif raw.get("text"):
        rank = [raw["text"]["attribute"], "BM25", raw["text"]["query"]]
    elif raw.get("vector"):
        rank = ["vector", "ANN", raw["vector"]]
    else:
        rank = None
    return parse(own | ({"rank_by": rank} if rank else {}) | ({"filters": raw["filter"]} if raw.get("filter") is not None else {}))


def query_vector(argument: Any, embedder: Callable | None) -> list[float]:
    """A literal vector, or the embedding of ["Embed", text]."""
    if isinstance(argument, list) and argument and argument[0] == "Embed":
        if len(argument) < 2 or not isinstance(argument[1], str):
            raise Invalid("Embed takes a text")
        if embedder is None:
            raise Unsupported("no embedder is configured")
        return vector.checked(embedder([argument[1]])[0])
    if not isinstance(argument, list):
        raise Invalid("the query vector must be a list")
    return vector.checked(argument)


def run(frame: DataFrame, query: Query, schema: Schema | None = None, index: ivf.IvfIndex | None = None, embedder: Callable | None = None, tail: Tail | None = None, ranked: bool = False, lists: Lists | None = None) -> Result:
    """One query over live rows. Aggregates cover everything that the filter keeps, not only the ranked rows.

    tail: what was written since the index was built; its rows are scored exactly and take the place of those in the
    index, the same in lists. ranked: lists ordered by an attribute say their order, as fusion needs.
    """
    schema = schema or Schema.of(frame)
    result = Result(plan={"ranking": query.kind, "indexed": False, "filtered": query.filter is not None, "prefiltered": False, "ordered": query.kind == "order", "consistent": not query.eventual_seconds, "eventual_seconds": query.eventual_seconds})
    common = {"k": query.top_k, "filter": query.filter, "include": query.include, "schema": schema}
    if query.kind in ("ann", "knn"):
        wanted = vector.checked(query_vector(query.argument, embedder), schema.dim)
        if query.kind == "ann" and index is not None:
            changed = tail.changed if tail else None
            result.rows = index.search(frame.sparkSession, wanted, query.top_k, query.nprobe, query.filter, query.include, schema, changed)
            if tail:
                late = ranking.knn(tail.rows, wanted, metric=schema.metric, **common)
                both = result.rows.unionByName(late, allowMissingColumns=True)
                result.rows = both.orderBy("dist", "id").limit(query.top_k)
            result.plan |= {"indexed": True, "nprobe": query.nprobe or index.nprobe, "clusters": len(index.centroids), "tail_rows": tail.entries if tail else 0}
        else:
            result.rows = ranking.knn(frame, wanted, metric=schema.metric, **common)
    elif lists and query.kind in ("bm25", "sparse") and lists.index.holds(query.attribute, _text_config(schema, query)):
        late = (tail.changed, tail.rows) if tail else (None, None)
        search = lists.index.bm25 if query.kind == "bm25" else lists.index.sparse
        result.rows = search(lists.rows, query.attribute, query.argument, query.top_k, query.filter, query.include, schema, *late)
        listed = query.filter is not None and lists.index.matching(frame.sparkSession, query.filter, schema) is not None
        result.plan |= {"indexed": True, "prefiltered": listed, "tail_rows": tail.entries if tail else 0}
    elif query.kind == "bm25":
        result.rows = ranking.bm25(frame, query.attribute, query.argument, **common)
    elif query.kind == "sparse":
        result.rows = ranking.sparse(frame, query.attribute, query.argument, **common)
    elif query.kind == "order":
        result.rows = ranking.order_by(frame, query.attribute, query.argument, ranked=ranked, **common)
    if query.aggregate_by is not None:
        kept = filters.apply(frame, query.filter, schema)
        result.aggregations = aggregate.aggregate(kept, query.aggregate_by, query.group_by, schema)
    return result


def _text_config(schema: Schema, query: Query) -> TextConfig | None:
    return schema.text.get(query.attribute) or TextConfig() if query.kind == "bm25" else None


def run_all(frame: DataFrame, raw: dict[str, Any], schema: Schema | None = None, index: ivf.IvfIndex | None = None, embedder: Callable | None = None, tail: Tail | None = None, lists: Lists | None = None):
    """A Result; for several queries a list of them, or one fused Result."""
    if raw.get("queries") is None:
        if raw.get("rerank_by") is not None:
            raise Invalid("rerank_by needs queries")
        return run(frame, parse(raw), schema, index, embedder, tail, lists=lists)
    if set(raw) - {"queries", "rerank_by", "top_k", "limit", "consistency"}:
        raise Invalid("a query of several takes queries, rerank_by, top_k, limit and consistency")
    if not isinstance(raw["queries"], list) or not 1 <= len(raw["queries"]) <= MOST_QUERIES:
        raise Invalid(f"queries must be a list of 1 to {MOST_QUERIES}")
    if any(isinstance(q, dict) and q.get("queries") is not None for q in raw["queries"]):
        raise Invalid("queries cannot be nested")
    fused = raw.get("rerank_by") is not None
    found = [run(frame, parse(q, nested=True), schema, index, embedder, tail, fused, lists) for q in raw["queries"]]
    if raw.get("rerank_by") is None:
        return found
    rerank = raw["rerank_by"]
    if not isinstance(rerank, list) or not rerank or not isinstance(rerank[0], str):
        raise Invalid("rerank_by must name a function")
    if rerank[0] != "RRF":
        raise Unsupported(f"rerank function {rerank[0]!r} is not known")
    k = (rerank[1] if len(rerank) > 1 else {}).get("k", RRF_K)
    limit = raw.get("top_k") or (raw.get("limit") or {}).get("total") or ranking.DEFAULT_TOP_K
    return Result(rows=ranking.fuse([r.rows for r in found if r.rows is not None], k, limit), plan={"ranking": "rrf"})


def execute(collection, raw: dict[str, Any]):
    """A request against a collection. ANN, BM25 and sparse products read the indexes and, beside them, what was written
    since; BM25 then counts documents and terms as they were when its lists were built."""
    seconds = _consistency(raw.get("consistency"))
    frame = collection.live(seconds)
    manifest = collection.manifest(seconds)
    index, listed = collection.index(manifest), collection.inverted(manifest)
    tail = Tail(*collection.tail(seconds)) if (index or listed) and (manifest.log or manifest.folded) else None
    lists = Lists(listed, collection.segment(manifest)) if listed else None
    return run_all(frame, raw, manifest.schema, index, collection.embedder, tail, lists=lists)


def json_rows(rows: DataFrame) -> list[dict[str, Any]]:
    """Ranked rows as clients get them: attributes beside the id, missing ones left out, the score under $dist."""
    out = []
    for row in rows.toLocalIterator():
        own = row.asDict(recursive=True)
        out.append({"$dist" if k in ("dist", "score") else k: v for k, v in own.items() if v is not None})
    return out
