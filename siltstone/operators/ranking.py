"""Rankings: nearest vectors, BM25, sparse products, order by attribute, rank fusion.

Every ranking sorts by its score and then by id and keeps k rows, which Spark runs as a partial top-k in each partition
and one merge of k rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import Invalid
from ..functions import text, vector
from ..schema import Schema
from ..sources.workspace import fresh
from . import filters

DEFAULT_TOP_K, MOST_TOP_K = 10, 10_000


def check_top_k(k: Any) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_TOP_K:
        raise Invalid(f"top_k must be between 1 and {MOST_TOP_K:,}")
    return k


def attribute_columns(frame: DataFrame, include: bool | Sequence[str] | None) -> list[str]:
    """Names that a projection keeps beside id: all, none or the known ones of a list."""
    known = [c for c in frame.columns if c not in ("id", "vector")]
    if include is True:
        return known
    if not include:
        return []
    return [c for c in dict.fromkeys(include) if c in known or c == "vector" and c in frame.columns]


def _projected(frame: DataFrame, include, *extra: str) -> DataFrame:
    names = [c for c in attribute_columns(frame, include) if c not in extra]
    return frame.select("id", *extra, *[f"`{c}`" for c in names])


def knn(frame: DataFrame, query: Sequence[float], k: int = DEFAULT_TOP_K, metric: str = "cosine", filter: Any = None, include=None, schema: Schema | None = None) -> DataFrame:
    """The k nearest rows by exact distance: id, dist and the attributes asked for. Rows without vector are left out."""
    schema = schema or Schema.of(frame)
    query = vector.checked(query, schema.dim)
    kept = filters.apply(frame, filter, schema).filter(F.col("vector").isNotNull())
    scored = kept.withColumn("dist", vector.distance(F.col("vector"), query, metric))
    return _projected(scored, include, "dist").orderBy("dist", "id").limit(check_top_k(k))


def order_by(frame: DataFrame, attribute: str, descending: bool = False, k: int = DEFAULT_TOP_K, filter: Any = None, include=None, schema: Schema | None = None, ranked: bool = False) -> DataFrame:
    """Rows by an attribute, missing values last in both directions; ranked adds their place as __rank, for fusion."""
    kept = filters.apply(frame, filter, schema or Schema.of(frame))
    if attribute in kept.columns:
        key = F.col(f"`{attribute}`")
        kept = kept.withColumn("__key", key)
        order = [F.col("__key").desc_nulls_last() if descending else F.col("__key").asc_nulls_last(), F.col("id").asc()]
    else:
        order = [F.col("id").asc()]
    names = [c for c in attribute_columns(frame, include)]
    top = kept.orderBy(*order).limit(check_top_k(k))
    # at most MOST_TOP_K rows are numbered
    place = [F.row_number().over(Window.orderBy(*order)).alias("__rank")] if ranked else []
    return top.select("id", *place, *[f"`{c}`" for c in names])


def sparse(frame: DataFrame, attribute: str, query: dict[str, float], k: int = DEFAULT_TOP_K, filter: Any = None, include=None, schema: Schema | None = None) -> DataFrame:
    """The k greatest products over shared dimensions; products of zero are left out, negative ones stay."""
    weights = sparse_weights(query)
    kept = filters.apply(frame, filter, schema or Schema.of(frame))
    total = sparse_score([F.try_element_at(F.col(f"`{attribute}`"), F.lit(n)) for n in weights], list(weights.values()))
    scored = kept.withColumn("score", total).filter("score <> 0")
    return _projected(scored, include, "score").orderBy(F.col("score").desc(), "id").limit(check_top_k(k))


def sparse_weights(query: dict[str, float]) -> dict[str, float]:
    """Weights other than zero, by name."""
    if not isinstance(query, dict):
        raise Invalid("a sparse query maps names to weights")
    return {str(n): float(w) for n, w in sorted(query.items()) if w}


def sparse_score(held: Sequence[Column], weights: Sequence[float]) -> Column:
    """The sum of products, missing values as 0, in the order given."""
    total = F.lit(0.0)
    for own, weight in zip(held, weights, strict=True):
        total = total + F.coalesce(own.cast("double"), F.lit(0.0)) * F.lit(weight)
    return total


def postings(frame: DataFrame, attribute: str, config: text.TextConfig, schema: Schema | None = None) -> DataFrame:
    """id, dl, term, tf and positions of every term of every row, counted within the row: nothing is exchanged."""
    kind = (schema or Schema.of(frame)).types.get(attribute, "string")
    # rows without terms are left out at the end: a filter before, also one that Spark infers, would find all terms twice
    held = frame.select("id", text.term_positions(text.joined(F.col(f"`{attribute}`"), kind), config).alias("terms"))
    length = F.aggregate("terms", F.lit(0), lambda total, t: total + F.size(t["positions"]))
    held = held.select("id", length.alias("dl"), "terms").select("id", "dl", F.inline_outer("terms")).filter("term is not null")
    return held.select("id", "dl", "term", F.size("positions").cast("long").alias("tf"), "positions")


def bm25(frame: DataFrame, attribute: str, query: str, k: int = DEFAULT_TOP_K, config: text.TextConfig | None = None, filter: Any = None, include=None, schema: Schema | None = None) -> DataFrame:
    """The k rows that match a text best, with statistics over the whole collection, filtered or not.

    One scan does all: term counts are taken from each row's tokens where they stand, the statistics of the query's terms
    are observed on the way, and the rows that hold a term are written with their counts. Those few are then scored.
    """
    schema = schema or Schema.of(frame)
    config = config or schema.text.get(attribute) or text.TextConfig()
    kind = schema.types.get(attribute, "string")
    wanted = list(dict.fromkeys(text.tokenize(query, config)))
    held = text.tokens(text.joined(F.col(f"`{attribute}`"), kind), config) if attribute in frame.columns else F.lit(None).cast("array<string>")
    names = attribute_columns(frame, include)
    if not wanted:
        return _projected(frame.filter(F.lit(False)).withColumn("score", F.lit(0.0)), names, "score")
    tfs = [_occurrences(w).cast("double").alias(f"__tf{i}") for i, w in enumerate(wanted)]
    passes = F.lit(True) if filter is None else filters.FilterCompiler(schema).compile(filter, total=True)
    own = [c for c in names if c != "score"]
    seen = Observation()
    rows = frame.withColumn("__tokens", held).withColumn("__passes", passes)
    rows = rows.select("id", *[f"`{c}`" for c in own], "__passes", F.coalesce(F.size("__tokens"), F.lit(0)).cast("double").alias("__dl"), *tfs)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("average"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))])
    some = F.lit(False)
    for i in range(len(wanted)):
        some = some | (F.col(f"__tf{i}") > 0)
    path = fresh(frame.sparkSession, "bm25")
    rows.filter(some).write.parquet(path)
    stats, kept = seen.get, frame.sparkSession.read.schema(rows.schema).parquet(path).filter("__passes")
    score = bm25_score([stats[f"df{i}"] or 0 for i in range(len(wanted))], stats["n"], stats["average"] or 0.0, config)
    scored = kept.withColumn("score", score).filter("score > 0")
    return _projected(scored, names, "score").orderBy(F.col("score").desc(), "id").limit(check_top_k(k))


def bm25_score(frequencies: Sequence[int], documents: int, average: float, config: text.TextConfig) -> Column:
    """The score of a row from its length __dl and the counts __tf0, __tf1, .. of the query's terms."""
    score = F.lit(0.0)
    for i, df in enumerate(frequencies):
        tf = F.col(f"__tf{i}")
        idf = F.log(F.lit(1.0) + F.lit((documents - df + 0.5) / (df + 0.5)))
        share = F.lit(1.0 - config.b) + F.lit(config.b) * F.col("__dl") / F.lit(average or 1.0)
        score = score + F.when(tf > 0, idf * tf * F.lit(config.k1 + 1.0) / (tf + F.lit(config.k1) * share)).otherwise(0.0)
    return score


def with_term_counts(frame: DataFrame, attribute: str, kind: str, wanted: Sequence[str], config: text.TextConfig) -> DataFrame:
    """The frame with __dl and __tf0, __tf1, .. beside its columns."""
    held = text.tokens(text.joined(F.col(f"`{attribute}`"), kind), config)
    rows = frame.withColumn("__tokens", held).withColumn("__dl", F.coalesce(F.size("__tokens"), F.lit(0)).cast("double"))
    return rows.withColumns({f"__tf{i}": _occurrences(w).cast("double") for i, w in enumerate(wanted)}).drop("__tokens")


def _occurrences(word: str) -> Column:
    return F.coalesce(F.size(F.filter(F.col("__tokens"), lambda t: t == word)), F.lit(0))


def fuse(rankings: Sequence[DataFrame], k: float = 60.0, limit: int = DEFAULT_TOP_K) -> DataFrame:
    """Reciprocal rank fusion: id and the sum of 1 / (k + rank). Each ranking has its order in a column dist, score or
    __rank.

    Ranks are numbered over at most MOST_TOP_K rows of each ranking, so the unpartitioned window holds a bounded list.
    Attributes come from the first ranking that has any for an id.
    """
    if k <= 0:
        raise Invalid("k must be positive")
    parts, schemas = [], {}
    for number, ranking in enumerate(rankings):
        if "dist" in ranking.columns:
            order = [F.col("dist").asc(), F.col("id").asc()]
        elif "score" in ranking.columns:
            order = [F.col("score").desc(), F.col("id").asc()]
        elif "__rank" in ranking.columns:
            order = [F.col("__rank").asc()]
        else:
            raise Invalid("a ranking to fuse needs a column dist, score or __rank")
        own = [c for c in ranking.columns if c not in ("id", "dist", "score", "__rank")]
        schemas |= {c: ranking.schema[c].dataType for c in own if c not in schemas}
        rank = F.row_number().over(Window.orderBy(*order))
        row = ranking.limit(MOST_TOP_K).withColumn("__n", rank)
        parts.append(row.select("id", F.lit(number).alias("__list"), (F.lit(1.0) / (F.lit(float(k)) + F.col("__n"))).alias("__part"), *[f"`{c}`" for c in own], F.lit(bool(own)).alias("__has")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    first = F.struct((~F.col("__has")).alias("late"), "__list")
    attrs = [F.min_by(F.struct(*[f"`{c}`" for c in schemas]), first).alias("__row")] if schemas else []
    # parts are added in list order, so equal sums are equal to the last bit
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("__list", "__part"))), F.lit(0.0), lambda t, x: t + x["__part"])
    out = union.groupBy("id").agg(total.alias("score"), *attrs)
    out = out.orderBy(F.col("score").desc(), "id").limit(check_top_k(limit))
    return out.select("id", "score", *[F.col("__row")[c].alias(c) for c in schemas])


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """The share of the exact ids that the other ranking has too; 1 if there are none."""
    found = approximate.select("id", F.lit(1).alias("__found")).distinct()
    both = exact.select("id").join(found, "id", "left")
    return both.agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.count("__found") / F.count(F.lit(1))).alias("recall"))


def recall_of_each(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """For many queries: how many ids the exact ranking of each has, and how many of these the other has too."""
    found = approximate.select("query", "id", F.lit(1).alias("__found")).distinct()
    both = exact.select("query", "id").join(found, ["query", "id"], "left")
    return both.groupBy("query").agg(F.count("__found").alias("found"), F.count(F.lit(1)).alias("wanted"))
