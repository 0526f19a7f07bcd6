"""Many nearest-neighbour queries in one pass over the rows.

The vectors of a batch of queries are broadcast; each task keeps the k best of its rows for each of them, and these are
merged by query. Products of blocks only choose candidates, with a margin for their rounding; candidates are then scored
from left to right, as a scan does, so distances, and ties between copies, are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ivf

#: Queries of a batch at most, cells of its table of queries and clusters at most, numbers held at once at most.
QUERIES, CELLS, NUMBERS = 8192, 16_000_000, 4_000_000
#: Rounding of a block's products, with room to spare, for vectors of length 1.
MARGIN = 1e-9


def batches(rows: DataFrame, clusters: int) -> Iterator[np.ndarray]:
    """The vectors of a frame, as many at a time as are searched together."""
    most = max(1, min(QUERIES, CELLS // max(1, clusters)))
    held = rows.filter(F.col("vector").isNotNull()).select("id", "vector")
    parts = -(-held.count() // most)
    for part in range(parts):
        some = held.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        found = matrix(some.select("vector").toArrow().column("vector").combine_chunks())
        if len(found):
            yield found


def matrix(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def nearest(rows: DataFrame, queries: np.ndarray, k: int, metric: str, probed: np.ndarray | None = None) -> DataFrame:
    """query (its place), id and dist of the k nearest rows of each query.

    probed: for each query, whether it reads a cluster; rows then name theirs in a column cluster.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((queries, probed))
    kind = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("dist", T.DoubleType())])

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, reads = shared.value
        own = Best(asked, k, metric)
        for part in parts:
            step = max(1, NUMBERS // max(1, asked.shape[1]))
            for at in range(0, part.num_rows, step):
                some = part.slice(at, step)
                block, ids = matrix(some.column("vector")), some.column("id").to_numpy(zero_copy_only=False)
                if reads is None:
                    own.add(block, ids, np.arange(len(asked)))
                    continue
                clusters = some.column("cluster").to_numpy(zero_copy_only=False)
                for c in np.unique(clusters):
                    here = clusters == c
                    own.add(block[here], ids[here], np.flatnonzero(reads[:, c]))
        own.settle()
        step = 10_000
        for at in range(0, len(own.query), step):
            columns = [pa.array(x[at : at + step]) for x in (own.query.astype(np.int32), own.id, own.dist)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "id", "dist"])

    names = ["id", "vector"] + (["cluster"] if probed is not None else [])
    found = rows.filter(F.col("vector").isNotNull()).select(*names).mapInArrow(best, kind)
    place = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))
    return found.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


class Best:
    """The k best rows so far of each query, by distance and then id."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.lengths = np.sqrt(_products(queries, queries))
        self.bar = np.full(len(queries), np.inf)
        self.query, self.id, self.dist = np.zeros(0, np.int64), None, np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> None:
        if not len(rows) or not len(asked):
            return
        lengths = np.sqrt(_products(rows, rows))
        step = max(1, NUMBERS // len(rows))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            rough = ivf.distances(self.queries[some], rows, self.metric)
            bar = self.bar[some]
            if len(rows) > self.k:
                bar = np.minimum(bar, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
            size = 1.0 if self.metric == "cosine" else (1 + self.lengths[some] + lengths.max()) ** 2
            which, row = np.nonzero(rough <= (bar + MARGIN * size)[:, None])
            for a in range(0, len(which), NUMBERS):
                q, r = some[which[a : a + NUMBERS]], row[a : a + NUMBERS]
                self.waiting.append((q, ids[r], self._exact(q, rows, r, lengths)))
                self.many += len(q)
                if self.many > max(NUMBERS, len(self.query)):
                    self.settle()
        if self.many > len(self.queries) * self.k:
            self.settle()

    def _exact(self, q: np.ndarray, rows: np.ndarray, r: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        if self.metric == "l2":
            for d in range(rows.shape[1]):
                gap = rows[r, d] - self.queries[q, d]
                out += gap * gap
            return out
        for d in range(rows.shape[1]):
            out += rows[r, d] * self.queries[q, d]
        if self.metric == "dot":
            return -out
        both = lengths[r] * self.lengths[q]
        return 1.0 - np.divide(out, both, out=np.zeros_like(out), where=both != 0)

    def settle(self) -> None:
        """Merge what waits into the best, and lower the bar that later rows have to pass."""
        if not self.waiting:
            self.id = np.zeros(0, np.int64) if self.id is None else self.id
            return
        held = [(self.query, self.id, self.dist)] if self.id is not None else []
        query, key, dist = (np.concatenate(x) for x in zip(*held, *self.waiting, strict=True))
        order = np.lexsort((key, dist, query))
        query, key, dist = query[order], key[order], dist[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        keep = place < self.k
        self.query, self.id, self.dist = query[keep], key[keep], dist[keep]
        last = place[keep] == self.k - 1
        self.bar[self.query[last]] = self.dist[last]
        self.waiting, self.many = [], 0


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from left to right."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out
