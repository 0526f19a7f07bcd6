"""Folding a log of upserts, patches and deletes into live rows.

A log has the columns id, op ("U", "P" or "D"), ord (a total order), touched (the names that a patch sets or removes),
and the row's own columns. Folding is one aggregation per id that is partial before the exchange: for each column the
latest entry that decides it, which is a whole write or a patch that names it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid
from ..schema import Schema
from . import filters

LOG_COLUMNS = ("id", "op", "ord", "touched")
DELETE_CAP, PATCH_CAP = 5_000_000, 50_000


def fold(log: DataFrame) -> DataFrame:
    """The live rows: a later upsert replaces, a delete removes, a patch merges and never brings back what is gone."""
    own = [c for c in log.columns if c not in LOG_COLUMNS]
    whole = F.col("op") != "P"

    def latest(name: str) -> Column:
        decides = whole | F.coalesce(F.array_contains("touched", name), F.lit(False))
        return F.max_by(F.col(f"`{name}`"), F.when(decides, F.col("ord"))).alias(name)

    state = F.max_by("op", F.when(whole, F.col("ord"))).alias("__state")
    folded = log.groupBy("id").agg(state, *[latest(c) for c in own])
    return folded.filter(F.col("__state") == "U").drop("__state")


def upserts(rows: DataFrame, ord: Column | None = None) -> DataFrame:
    return _entries(rows, "U", F.lit(None).cast("array<string>"), ord)


def deletes(ids: DataFrame, like: DataFrame, ord: Column | None = None) -> DataFrame:
    """Delete entries for ids, with the columns of `like`."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in LOG_COLUMNS]
    return _entries(ids.select("id", *empty), "D", F.lit(None).cast("array<string>"), ord)


def patches(rows: DataFrame, touched: list[str], ord: Column | None = None) -> DataFrame:
    """Patch entries: the touched columns are set, a null there removes. The vector cannot be patched."""
    if "vector" in touched:
        raise Invalid("a patch cannot change the vector")
    return _entries(rows, "P", F.array(*[F.lit(t) for t in touched]), ord)


def _entries(rows: DataFrame, op: str, touched: Column, ord: Column | None) -> DataFrame:
    marked = rows.withColumn("op", F.lit(op)).withColumn("touched", touched)
    return marked if ord is None else marked.withColumn("ord", ord)


def matching_ids(live: DataFrame, filter: Any, cap: int, schema: Schema | None = None) -> DataFrame:
    """The ids that a filter keeps, the smallest first, at most cap of them."""
    return filters.apply(live, filter, schema).select("id").orderBy("id").limit(cap)


def delete_by_filter(live: DataFrame, filter: Any, cap: int = DELETE_CAP, schema: Schema | None = None) -> DataFrame:
    """The live rows without those that match; at most cap go at once, the smallest ids first."""
    return live.join(matching_ids(live, filter, cap, schema), "id", "left_anti")


def patch_by_filter(live: DataFrame, filter: Any, patch: dict[str, Any], cap: int = PATCH_CAP, schema: Schema | None = None) -> DataFrame:
    """The live rows with a patch applied to those that match."""
    if not patch:
        raise Invalid("the patch is empty")
    if "vector" in patch or "id" in patch:
        raise Invalid("a patch cannot change id or vector")
    chosen = matching_ids(live, filter, cap, schema).withColumn("__hit", F.lit(True))
    out = live.join(chosen, "id", "left")
    for name, value in patch.items():
        before = F.col(f"`{name}`") if name in live.columns else F.lit(None)
        new = F.lit(value).cast(live.schema[name].dataType) if name in live.columns else F.lit(value)
        out = out.withColumn(name, F.when(F.col("__hit"), new).otherwise(before))
    return out.drop("__hit")


def shard_of(id_column: Column, shards: int) -> Column:
    """A stable shard from 0 for an id."""
    return F.pmod(F.xxhash64(id_column.cast("string")), F.lit(shards)).cast("int")
