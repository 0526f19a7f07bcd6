"""Inverted lists of a segment: for each searched text its terms with positions, for each sparse attribute its dimensions,
and for filters the ids of each value, elements of lists among them.

Each list table is partitioned by a hash of its key, so a search for some keys reads the folders of their buckets alone.
Rows are dealt to files by range of (bucket, key, id): a key that a third of all documents hold fills many files.
Statistics are those of the segment; rows written since are scored against them until the next compaction.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..schema import Schema
from . import filters, ranking

#: Bytes of segment, and of entries as first written, for one file of lists; and folders of a table at most.
FILE_BYTES, ENTRY_BYTES, MOST_BUCKETS = 128 << 20, 24 << 20, 4096
#: Kinds of values whose ids are listed, all in one table under this name.
VALUE_KINDS, VALUES = {"bool", "uint", "int", "string", "uuid", "datetime"}, ""


@dataclass
class InvertedIndex:
    """What is listed, by attribute: its folder, number of buckets, kind, and for texts configuration and statistics."""

    path: str
    lists: dict[str, dict[str, Any]]

    @classmethod
    def build(cls, frame: DataFrame, path: str, schema: Schema, size: int) -> InvertedIndex | None:
        """Lists of all rows; size: bytes of the frame as stored, or less: more files are made for lists that turn out to
        need them. None if the schema has nothing to list."""
        spark, lists = frame.sparkSession, {}
        least = max(1, -(-size // FILE_BYTES))
        for name, kind in sorted(schema.types.items()):
            own = {"folder": f"lists{len(lists)}", "kind": kind}
            target = f"{path}/{own['folder']}"
            if name in schema.text:
                config = schema.text[name]
                own["buckets"] = _written(ranking.postings(frame, name, config, schema).withColumnRenamed("term", "key"), target, least)
                n, tokens = frame.count(), spark.read.parquet(target).agg(F.sum("tf")).first()[0] or 0
                own |= {"documents": n, "average": tokens / n if n else 0.0, "config": config.to_json()}
            elif kind == "sparse":
                entries = frame.select("id", F.explode(F.col(f"`{name}`")).alias("key", "weight")).filter("weight <> 0")
                own["buckets"] = _written(entries, target, least)
            else:
                continue
            lists[name] = own
        named = [n for n, kind in sorted(schema.types.items()) if n not in schema.text and values.ELEMENT.get(kind, kind) in VALUE_KINDS]
        if named:
            own = {"folder": "values", "kind": "values", "names": named}
            keys = F.filter(F.concat(*[_value_keys(n, schema.types[n]) for n in named]), lambda k: k.isNotNull())
            own["buckets"] = _written(frame.select("id", F.explode(keys).alias("key")), f"{path}/values", least)
            lists[VALUES] = own
        if not lists:
            return None
        spark.createDataFrame([(json.dumps(lists),)], "meta string").coalesce(1).write.text(f"{path}/meta")
        return cls(path, lists)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls(path, json.loads(spark.read.text(f"{path}/meta").first()[0]))

    def holds(self, attribute: str, config: text.TextConfig | None = None) -> bool:
        """Whether an attribute is listed, with this configuration if it is a text."""
        own = self.lists.get(attribute)
        return own is not None and own["kind"] != "values" and own.get("config") == (config.to_json() if config else None)

    def entries(self, spark: SparkSession, attribute: str, keys: Sequence[str | Column]) -> DataFrame:
        """The list entries of some keys; their buckets are folded to constants and prune folders."""
        own = self.lists[attribute]
        rows = spark.read.parquet(f"{self.path}/{own['folder']}")
        if not keys:
            return rows.filter(F.lit(False))
        keys = [F.lit(k) for k in keys]
        buckets = [_bucket(k, own["buckets"]) for k in keys]
        return rows.filter(F.col("bucket").isin(*buckets) & F.col("key").isin(*keys)).drop("bucket")

    def matching(self, spark: SparkSession, filter: Any, schema: Schema) -> tuple[DataFrame, bool] | None:
        """Ids (repeats possible) among which all matches of a filter are, and whether they are just these; None if no
        list bounds the filter: comparisons, patterns, texts, null and negations are left to the scan."""
        return self._matching(spark, filters.parse(filter), schema) if VALUES in self.lists else None

    def _matching(self, spark: SparkSession, tree: tuple, schema: Schema) -> tuple[DataFrame, bool] | None:
        if tree[0] == "leaf":
            keys = self._keys(*tree[1:], schema)
            return None if keys is None else (self.entries(spark, VALUES, keys).select("id"), True)
        if tree[0] == "Not":
            return None
        found = [self._matching(spark, t, schema) for t in tree[1]]
        known = [f for f in found if f]
        if not known or tree[0] == "Or" and len(known) < len(found):
            return None
        ids = known[0][0]
        for other, _ in known[1:]:
            ids = ids.join(other, "id", "left_semi") if tree[0] == "And" else ids.union(other)
        return ids, len(known) == len(found) and all(exact for _, exact in known)

    def _keys(self, name: str, op: str, raw: Any, schema: Schema) -> list[Column] | None:
        """The keys of the values that a leaf asks for, if its operator is one of equality."""
        kind = schema.types.get(name)
        if name not in self.lists[VALUES]["names"] or op not in (("Contains", "ContainsAny") if kind in values.ELEMENT else ("Eq", "In")):
            return None
        wanted = list(raw) if op in ("In", "ContainsAny") and isinstance(raw, (list, tuple)) else [raw]
        if any(x is None for x in wanted):
            return None
        element = values.ELEMENT.get(kind, kind)
        compiler = filters.FilterCompiler(schema)
        return [_value_key(name, filters.literal(compiler.coerced(name, x, element), element)) for x in wanted]

    def bm25(self, rows: DataFrame, attribute: str, query: str, k: int, filter: Any = None, include=None, schema: Schema | None = None, changed: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
        """The k best of the segment's rows and of late, which takes the place of the rows whose ids are in changed."""
        own, schema = self.lists[attribute], schema or Schema.of(rows)
        config = text.TextConfig(**own["config"])
        wanted = list(dict.fromkeys(text.tokenize(query, config)))
        held = self.entries(rows.sparkSession, attribute, wanted)
        counted = {r["key"]: r["df"] for r in held.groupBy("key").agg(F.count(F.lit(1)).alias("df")).collect()}  # the query's terms
        score = ranking.bm25_score([counted.get(w, 0) for w in wanted], own["documents"], own["average"], config)
        tfs = [F.coalesce(F.max(F.when(F.col("key") == w, F.col("tf"))), F.lit(0)).cast("double").alias(f"__tf{i}") for i, w in enumerate(wanted)]
        found = held.groupBy("id").agg(F.first("dl").cast("double").alias("__dl"), *tfs).select("id", score.alias("score"))
        if late is not None:
            kind = schema.types.get(attribute, "string")
            late = ranking.with_term_counts(filters.apply(late, filter, schema), attribute, kind, wanted, config).withColumn("score", score)
        return self._best(found.filter("score > 0"), rows, k, filter, include, schema, changed, late and late.filter("score > 0"))

    def sparse(self, rows: DataFrame, attribute: str, query: dict[str, float], k: int, filter: Any = None, include=None, schema: Schema | None = None, changed: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
        """As bm25, by products over shared dimensions, added up in the order that a scan has."""
        schema, weights = schema or Schema.of(rows), ranking.sparse_weights(query)
        held = self.entries(rows.sparkSession, attribute, list(weights))
        parts = [F.max(F.when(F.col("key") == name, F.col("weight"))).alias(f"__w{i}") for i, name in enumerate(weights)]
        found = held.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), *parts)
        found = found.select("id", ranking.sparse_score([F.col(f"__w{i}") for i in range(len(weights))], list(weights.values())).alias("score"))
        if late is not None:
            column = F.col(f"`{attribute}`")
            total = ranking.sparse_score([F.try_element_at(column, F.lit(n)) for n in weights], list(weights.values()))
            late = filters.apply(late, filter, schema).withColumn("score", total)
        return self._best(found.filter("score <> 0"), rows, k, filter, include, schema, changed, late and late.filter("score <> 0"))

    def _best(self, found: DataFrame, rows: DataFrame, k: int, filter: Any, include, schema: Schema, changed: DataFrame | None, late: DataFrame | None) -> DataFrame:
        """The k best of (id, score) with the attributes of the segment's rows, merged with the rows written since."""
        names = [n for n in ranking.attribute_columns(rows, include) if n != "score"]
        order = [F.col("score").desc(), F.col("id").asc()]
        if changed is not None:
            found = found.join(changed, "id", "left_anti")
        own = rows.select("id", *[f"`{n}`" for n in names])
        bounded = self.matching(rows.sparkSession, filter, schema) if filter is not None else None
        if bounded:
            found = found.join(bounded[0], "id", "left_semi")
        scanned = filter is not None and not (bounded and bounded[1])
        if scanned:
            found = found.join(filters.apply(rows, filter, schema).select("id", *[f"`{n}`" for n in names]), "id")
        top = found.orderBy(*order).limit(ranking.check_top_k(k))
        if names and not scanned:
            top = own.join(F.broadcast(top), "id")  # at most MOST_TOP_K rows
        top = top.select("id", "score", *[f"`{n}`" for n in names])
        if late is not None:
            top = top.unionByName(late.select("id", "score", *[f"`{n}`" for n in names]))
        return top.orderBy(*order).limit(k)


def _value_key(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + "\0"), value.cast("string"))


def _value_keys(name: str, kind: str) -> Column:
    """The keys of a row's attribute; null ones are no keys."""
    column = F.col(f"`{name}`")
    if kind not in values.ELEMENT:
        return F.array(_value_key(name, column))
    return F.coalesce(F.transform(F.array_distinct(column), lambda x: _value_key(name, x)), F.array().cast("array<string>"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(entries: DataFrame, path: str, least: int) -> int:
    """Write a table of lists and return its number of buckets.

    Entries are first written as they come: that shows how many files they need, and neither the sample for the ranges
    nor the sort works the entries out again.
    """
    spark, loose = entries.sparkSession, f"{path}.loose"
    entries.write.parquet(loose)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(loose)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = max(least, -(-int(fs.getContentSummary(folder).getLength()) // ENTRY_BYTES))
    buckets = min(MOST_BUCKETS, 1 << files.bit_length())
    rows = spark.read.schema(entries.schema).parquet(loose).withColumn("bucket", _bucket(F.col("key"), buckets))
    rows = rows.repartitionByRange(files, "bucket", "key", "id").sortWithinPartitions("bucket", "key", "id")
    rows.write.partitionBy("bucket").parquet(path)
    fs.delete(folder, True)
    return buckets
