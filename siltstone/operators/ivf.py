"""Inverted-file vector index: k-means clusters as partitions of a Parquet table.

Centroids are fitted on at most SAMPLE vectors, evenly strided in id order by a hash bound, so what reaches the driver
has a fixed bound; every vector is then assigned in Arrow batches and the table is written partitioned by cluster. A
query ranks the centroids on the driver and reads only the partitions of the nearest: as many as, when the index was
built, gave vectors of the sample CALIBRATED of their exact neighbours in the sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..functions import vector
from ..schema import Schema
from . import filters, many, ranking

#: Vectors that centroids are fitted on, at most; and clusters at most.
SAMPLE = 100_000
MOST_CLUSTERS = 16_384
ITERATIONS = 10
#: Clusters that a query reads at least, if it names no number.
DEFAULT_NPROBE = 8
#: Recall wanted of CALIBRATION_K neighbours, on average over at most CALIBRATION_QUERIES vectors of the sample; 0.9 is
#: asked of any queries, so a few hundredths more are wanted of these.
CALIBRATED, CALIBRATION_K, CALIBRATION_QUERIES = 0.95, 20, 200


def distances(rows: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    products = rows @ centroids.T
    if metric == "dot":
        return -products
    if metric == "l2":
        return (rows**2).sum(1)[:, None] - 2 * products + (centroids**2).sum(1)[None, :]
    lengths = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(centroids, axis=1)[None, :]
    return 1 - np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0)


def kmeans(rows: np.ndarray, k: int, metric: str = "cosine", iterations: int = ITERATIONS) -> np.ndarray:
    """Lloyd's iterations from a strided start; ties go to the lowest cluster, empty ones keep their centroid."""
    n = len(rows)
    k = max(1, min(k, n))
    centroids = rows[np.arange(k) * n // k].astype(np.float64)
    for _ in range(iterations):
        own = nearest(rows, centroids, metric)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids[np.unique(nearest(rows, centroids, metric))]


def nearest(rows: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    step = max(1, 4_000_000 // max(1, len(centroids)))
    parts = [distances(rows[a : a + step], centroids, metric).argmin(1) for a in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def probes_needed(rows: np.ndarray, centroids: np.ndarray, metric: str) -> int:
    """The least number of clusters, DEFAULT_NPROBE or more, that holds CALIBRATED of the nearest rows of rows."""
    if not len(rows):
        return DEFAULT_NPROBE
    many = min(CALIBRATION_QUERIES, len(rows))
    own, held = nearest(rows, centroids, metric), np.zeros(len(centroids))
    for q in rows[np.arange(many) * len(rows) // many]:
        found = np.argsort(distances(q[None], rows, metric)[0], kind="stable")[:CALIBRATION_K]
        rank = np.empty(len(centroids), dtype=np.int64)
        rank[np.argsort(distances(q[None], centroids, metric)[0], kind="stable")] = np.arange(len(centroids))
        np.add.at(held, rank[own[found]], 1 / len(found) / many)
    enough = int(np.searchsorted(np.cumsum(held), CALIBRATED - 1e-9)) + 1
    return max(DEFAULT_NPROBE, min(enough, len(centroids)))


@dataclass
class IvfIndex:
    path: str
    centroids: np.ndarray
    metric: str
    documents: int
    nprobe: int = DEFAULT_NPROBE

    @classmethod
    def build(cls, frame: DataFrame, path: str, metric: str = "cosine", sample: int = SAMPLE, clusters: int | None = None) -> IvfIndex:
        """Write the table of all rows that have a vector, partitioned by cluster, and the centroids beside it."""
        spark = frame.sparkSession
        held = frame.filter(F.col("vector").isNotNull())
        n = held.count()
        share = max(1, -(-n // sample))
        # about n / share rows by hash of the id; the limit only guards the bound
        chosen = held.select("id", "vector").filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy("id").limit(2 * sample)
        # in Arrow batches, so no vector becomes a list of Python numbers
        held_vectors = chosen.select("vector").toArrow().column("vector").combine_chunks()
        rows = held_vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held_vectors), -1) if len(held_vectors) else np.zeros((0, 1))
        k = clusters or min(MOST_CLUSTERS, math.isqrt(max(0, n - 1)) + 1)
        centroids = kmeans(rows, k, metric) if len(rows) else np.zeros((0, 1))
        cls._assigned(held, centroids, metric).write.partitionBy("cluster").parquet(f"{path}/rows")
        nprobe = probes_needed(rows, centroids, metric)
        meta = json.dumps({"metric": metric, "documents": n, "nprobe": nprobe, "centroids": centroids.tolist()})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.text(f"{path}/centroids")
        return cls(path, centroids, metric, n, nprobe)

    @staticmethod
    def _assigned(held: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
        shared = held.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CLUSTERS rows

        @F.pandas_udf(T.IntegerType())
        def cluster(vectors):
            import pandas as pd

            rows = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, shared.value.shape[1]))
            return pd.Series(nearest(rows, shared.value, metric).astype(np.int32))

        out = held.withColumn("cluster", cluster("vector"))
        # a salt beside the cluster, so one crowded cluster is written by several tasks
        return out.repartition(F.col("cluster"), F.pmod(F.xxhash64("id"), F.lit(4)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        meta = json.loads(spark.read.text(f"{path}/centroids").first()[0])
        return cls(path, np.array(meta["centroids"]), meta["metric"], meta["documents"], meta.get("nprobe", DEFAULT_NPROBE))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def probe(self, query: Sequence[float], nprobe: int | None = None) -> list[int]:
        if not len(self.centroids):
            return []
        nprobe = self.nprobe if nprobe is None else nprobe
        d = distances(np.array([query], dtype=np.float64), self.centroids, self.metric)[0]
        return np.argsort(d, kind="stable")[: max(1, nprobe)].tolist()

    def search(self, spark: SparkSession, query: Sequence[float], k: int = 10, nprobe: int | None = None, filter: Any = None, include=None, schema: Schema | None = None, without: DataFrame | None = None) -> DataFrame:
        """The k nearest among the rows of the nprobe nearest clusters; of a filtered search, the k nearest of all that match.

        without: ids (a frame) whose rows in the index no longer count.
        """
        nprobe = self.nprobe if nprobe is None else nprobe
        query = vector.checked(query, self.centroids.shape[1] if len(self.centroids) else None)
        rows = self.rows(spark)
        schema = schema or Schema.of(rows.drop("cluster"))
        near = self.probe(query, nprobe)
        if filter is not None:
            # a row for each cluster, from the filter's columns alone
            held = filters.apply(rows, filter, schema).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()
            near = self.enough(self.probe(query, len(self.centroids)), nprobe, {r["cluster"]: r["n"] for r in held}, math.inf)
        rows = rows.filter(F.col("cluster").isin(near)) if near else rows.filter(F.lit(False))
        if without is not None:
            rows = rows.join(without, "id", "left_anti")
        return ranking.knn(rows.drop("cluster"), query, k, self.metric, filter, include, schema)

    def search_many(self, spark: SparkSession, queries: np.ndarray, k: int = 10, nprobe: int | None = None) -> DataFrame:
        """query (its place), id and dist of the k nearest rows in the nprobe nearest clusters of each of many queries."""
        probed = np.zeros((len(queries), len(self.centroids)), dtype=bool)
        for place, query in enumerate(queries):
            probed[place, self.probe(query, nprobe)] = True
        read = np.flatnonzero(probed.any(axis=0)).tolist()
        return many.nearest(self.rows(spark).filter(F.col("cluster").isin(read)), queries, k, self.metric, probed)

    @staticmethod
    def enough(ranked: Sequence[int], nprobe: int, matches: dict[int, int], wanted: float) -> list[int]:
        """The nearest clusters that have matches: nprobe of all clusters, and on from there until `wanted` matches."""
        chosen, found = [], 0
        for place, cluster in enumerate(ranked):
            if place >= nprobe and found >= wanted:
                break
            if matches.get(cluster):
                chosen.append(cluster)
                found += matches[cluster]
        return chosen


def check_nprobe(n: Any) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise Invalid("nprobe must be a positive number")
    return n
