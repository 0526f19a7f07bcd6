"""Near-duplicates by SimHash fingerprints, found with the pigeonring filter.

A fingerprint of 64 bits is a ring of eight segments. If two fingerprints differ in at most four bits, then somewhere
on the ring starts a chain whose first l segments differ in at most l/2 bits together, for every l. So a chain starts
with an equal segment, has at most one differing segment among the first three, at most two among five, three among
seven. The sets of equal segments that such chains allow are the index: fingerprints meet where they agree on one of
these sets. Chains are then followed around the ring segment by segment, and only pairs with a whole chain are given the full Hamming check.

Copies share a fingerprint and are one node. Within a meeting place of n fingerprints only the edges of a spanning
forest come out, so a group of near copies never turns into all its pairs; places of more than RUN fingerprints are
cut into blocks and each pair of blocks is a task of its own. Components are found in Spark.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; with fewer words than a
shingle the whole sequence is the shingle; repeated rows get equal results; a null id counts only where no document of
a component has an id; the document that stands for a component is the one with the smallest id and then the smallest
hash of its text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import staged

SEGMENTS, BITS = 8, 8
RADIUS = 4
SHINGLE = 4
#: Chain length that the index follows: 5 gives 40 sets of 24 bits, 7 gives 70 sets of 32 bits.
CHAIN = 7
#: Fingerprints of one meeting place that a task compares at a time.
RUN = 8192
LONG = 1 << 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    bits = np.zeros(64, dtype=np.int64)
    grid = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 65536):
        bits += np.unpackbits(grid[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, own (tells texts under one id apart) and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "own", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("own"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, own long, fp long")


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def chain_sets(chain: int = CHAIN) -> list[int]:
    """Masks of the segments that are equal along some chain of this length; no mask contains another's chain twice."""
    size = 1 + (chain - 1) // 2
    found = set()
    for start in range(SEGMENTS):
        for rest in combinations(range(1, chain), size - 1):
            if all(at <= 2 * (i + 1) for i, at in enumerate(rest)):
                found.add(frozenset((start + at) % SEGMENTS for at in (0, *rest)))
    return [sum(255 << BITS * s for s in chosen) for chosen in sorted(found, key=sorted)]


def _chained(differing: np.ndarray) -> np.ndarray:
    """Which of these differences have a chain around the whole ring within proportional budgets."""
    d = np.bitwise_count(np.ascontiguousarray(differing).view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int16)
    ring = np.concatenate([d, d], axis=1)
    sums = np.concatenate([np.zeros((len(d), 1), np.int16), np.cumsum(ring, axis=1, dtype=np.int16)], axis=1)
    whole = np.zeros(len(d), dtype=bool)
    for start in range(SEGMENTS):
        going = np.ones(len(d), dtype=bool)
        for length in range(1, SEGMENTS + 1):
            going &= sums[:, start + length] - sums[:, start] <= length * RADIUS // SEGMENTS
        whole |= going
    return whole


def near(differing: np.ndarray) -> np.ndarray:
    keep = np.flatnonzero(_chained(differing))
    return keep[np.bitwise_count(differing[keep]) <= RADIUS]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join distinct fingerprints as the links do, at most one fewer than fingerprints."""
    edges, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(left ^ x)
            if len(hit):
                found = left[hit]
                edges += [(int(x), int(y)) for y in found]
                queue.extend(found)
                left = np.delete(left, hit)
    return edges


def _runs(batches, most: int | None):
    """Rows (place, key, fp) sorted by place and key. Yields edges (a, b), and what exceeds `most` as (place, key, fp)."""
    carry: list[np.ndarray] = []
    spilling: tuple | None = None

    def out(edges=(), late=None):
        a = np.array([e[0] for e in edges], dtype=np.uint64).view(np.int64)
        b = np.array([e[1] for e in edges], dtype=np.uint64).view(np.int64)
        p, k, f = late if late is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        pad_a, pad_b = np.zeros(len(f), np.int64), np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "late": pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(f), bool)]),
                "a": pa.array(np.r_[a, pad_a]),
                "b": pa.array(np.r_[b, pad_a]),
                "place": pa.array(np.r_[pad_b.astype(np.int32), p].astype(np.int32)),
                "key": pa.array(np.r_[pad_b, k]),
                "fp": pa.array(np.r_[pad_b, f]),
            }
        )

    def closed(place, key, fp):
        """Whole runs only."""
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(place)])
        twos = starts[sizes == 2]
        a, b = fp[twos].view(np.uint64), fp[twos + 1].view(np.uint64)
        hit = near(a ^ b) if len(twos) else []
        edges = list(zip(a[hit].tolist(), b[hit].tolist(), strict=True))
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            edges += forest(np.unique(fp[at : at + n]).view(np.uint64))
        return out(edges)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if spilling is not None:
            same = (new[0] == spilling[0]) & (new[1] == spilling[1])
            if same.any():
                yield out(late=tuple(c[same] for c in new))
                new = [c[~same] for c in new]
            if not len(new[0]):
                continue
            spilling = None
        rows = [np.concatenate([c, n]) for c, n in zip(carry, new, strict=True)] if carry else new
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield closed(*(c[:cut] for c in rows))
        carry = [c[cut:] for c in rows]
        if most and len(carry[0]) > most:
            yield out(late=tuple(carry))
            spilling, carry = (carry[0][0], carry[1][0]), []
    if carry:
        yield closed(*carry)


_OUT = "late boolean, a long, b long, place int, key long, fp long"


def links(distinct: DataFrame, chain: int = CHAIN, run: int = RUN) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join exactly what links of RADIUS bits join."""
    masks = [m - LONG if m >= LONG // 2 else m for m in chain_sets(chain)]
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    met = distinct.select("fp", F.explode(places).alias("at")).select("at.place", "at.key", "fp")
    met = met.repartition("place", "key").sortWithinPartitions("place", "key")
    found = staged(met.mapInArrow(lambda b: _runs(b, run), _OUT), "simhash-links")
    edges = found.filter("not late").select("a", "b")
    # what was put off: each pair of blocks of a crowded place is compared by itself
    late = found.filter("late").select("place", "key", "fp")
    sizes = late.groupBy("place", "key").agg(F.ceil(F.count(F.lit(1)) / (run // 2)).cast("int").alias("blocks"))
    blocks = late.join(sizes, ["place", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(
        F.xxhash64("place", "key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.lit(0).alias("place"), "fp"
    )
    blocks = blocks.repartition("key").sortWithinPartitions("key").select("place", "key", "fp")
    rest = blocks.mapInArrow(lambda b: _runs(b, None), _OUT).select("a", "b")
    return edges.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, chain: int = CHAIN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    found = _grouped(docs, id_col, text_col, shingle, chain)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and own (text_mark) of all documents but the one that stands for their component."""
    found = _grouped(docs, id_col, text_col, SHINGLE, CHAIN)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("own") == F.col("component_own"))
    return found.filter(~stays).select("doc_id", "own").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, chain: int) -> DataFrame:
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("first")), "distinct")
    roots = staged(components(links(distinct.select("fp"), chain)), "roots")
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.own").alias("component_own"))
    # written, so that both sides of the join with the documents are dealt anew and a hot fingerprint can be split
    named = staged(joined.join(least, "root").select(F.col("fp").alias("__fp"), "component_id", "component_own"), "components")
    return marked.join(named, F.col("fp") == F.col("__fp")).drop("__fp")


def op9_pigeonring_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
