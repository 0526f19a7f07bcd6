"""Benchmark decontamination by SimHash of item-sized windows.

For every length that a benchmark item has, a window of as many words slides over the whole text. A window's SimHash is
looked up in a multi-index: the 64 bits are cut into eight blocks, and if two fingerprints differ in at most RADIUS
bits, some block differs in at most RADIUS // 8, so the items in the blocks' small balls are all that can be within
the radius. Candidates within it are verified exactly: the weighted Jaccard similarity of the multisets of five-word
shingles, each weighted by its count, must reach 0.8.

A window that passes the verification shares at least 8/9 of its shingles with an item of its length. Windows that hold
fewer shingles of every such item are passed over before fingerprinting, which loses nothing and leaves few windows.

The benchmark is read in blocks of bounded size (BLOCK_BYTES of text), one pass over the documents for each, so what is
sent to the tasks has a fixed bound however large the benchmark.

An item that is longer than a document is compared with the whole document, which can reach 0.8 if little is missing.

Defined cases: words are runs of letters, digits and underscores in lower case; an item of fewer than five words has
one shingle, the whole item; items without words match nothing; null and empty texts have no matches; of several
windows of a document that match an item the most similar, then the first is reported; repeated rows give repeated
results; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import text_mark

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 20
BLOCKS, BLOCK_BITS = 8, 8
BLOCK_BYTES = 1 << 20
_WORD = re.compile(r"\w+").findall
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def words(text: str | None) -> list[str]:
    return _WORD((text or "").lower())


def shingle_hashes(tokens: list[str]) -> list[int]:
    import xxhash

    n = max(1, len(tokens) - SHINGLE + 1)
    return [xxhash.xxh64_intdigest(" ".join(tokens[i : i + SHINGLE])) for i in range(n)]


def signs(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.tokens = [], []
        for item_id, text in items:
            tokens = words(text)
            if tokens:
                self.ids.append(item_id)
                self.tokens.append(tokens)
        self.hashes = [shingle_hashes(t) for t in self.tokens]
        self.counts = [Counter(h) for h in self.hashes]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.sizes = sorted(set(self.lengths.tolist()))
        self.fps = np.array([int(fingerprint(signs(h).sum(axis=0, keepdims=True))[0]) for h in self.hashes], dtype=np.uint64)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in self.tokens for w in t}))}
        self.keys = {}
        for n in sorted({min(SHINGLE, s) for s in self.sizes}):
            mine = [i for i, t in enumerate(self.tokens) if min(SHINGLE, len(t)) == n]
            own = [self._keys(np.array([self.vocabulary[w] for w in self.tokens[i]], dtype=np.uint64), n)[0] for i in mine]
            pairs = np.unique(np.stack([np.concatenate(own), np.repeat(np.array(mine, np.uint64), [len(o) for o in own])]), axis=1)
            keys, first = np.unique(pairs[0], return_index=True)
            table = np.zeros(1 << 18, dtype=bool)
            table[(keys >> np.uint64(40)) & np.uint64(0x3FFFF)] = True
            self.keys[n] = (keys, table, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64))
        self.places: list[list[np.ndarray]] = []
        near = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)]
        for block in range(BLOCKS):
            cells: dict[int, list[int]] = defaultdict(list)
            for i, f in enumerate(self.fps.tolist()):
                value = f >> block * BLOCK_BITS & 0xFF
                for change in near:
                    cells[value ^ change].append(i)
            self.places.append([np.array(cells.get(v, ()), dtype=np.int64) for v in range(256)])

    @staticmethod
    def _keys(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of runs of n known words, and which runs have only known words."""
        many = len(ids) - n + 1
        keys, known = np.zeros(many, dtype=np.uint64), np.ones(many, dtype=bool)
        for k in range(n):
            part = ids[k : k + many]
            keys = (keys ^ part * _MIX[k]) * _MIX[0]
            keys ^= keys >> np.uint64(29)
            known &= part > 0
        return keys, known

    def candidates(self, fp: int, length: int) -> np.ndarray:
        """Items of this length within the radius: all of them."""
        met = np.unique(np.concatenate([self.places[b][fp >> b * BLOCK_BITS & 0xFF] for b in range(BLOCKS)]))
        met = met[self.lengths[met] == length]
        return met[np.bitwise_count(self.fps[met] ^ np.uint64(fp)) <= RADIUS]

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each matching item."""
        tokens = words(text)
        if not tokens or not self.ids:
            return []
        ids = np.fromiter(map(self.vocabulary.get, tokens, [0] * len(tokens)), dtype=np.uint64, count=len(tokens))
        if not ids.any():
            return []
        starts: dict[int, set[int]] = {}
        longer: list[int] = []
        for n, (keys, table, first, owners) in self.keys.items():
            if len(ids) < n:
                continue
            own, known = self._keys(ids, n)
            maybe = np.flatnonzero(known & table[(own >> np.uint64(40)) & np.uint64(0x3FFFF)])
            at = np.searchsorted(keys, own[maybe])
            hits = keys[np.minimum(at, len(keys) - 1)] == own[maybe]
            maybe, at = maybe[hits], at[hits]
            if not len(maybe):
                continue
            # each place of a run once for every item that has the run
            many = first[at + 1] - first[at]
            places = np.repeat(maybe, many)
            items = owners[np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            order = np.argsort(items, kind="stable")
            items, places = items[order], places[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(items)) + 1, [len(items)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                size = int(self.lengths[items[a]])
                per = size - n + 1
                if size > len(tokens):
                    if b - a >= math.ceil(SIMILAR * (per + len(tokens) - n + 1) / (1 + SIMILAR) - 1e-9):
                        longer.append(int(items[a]))
                    continue
                need = math.ceil(2 * SIMILAR * per / (1 + SIMILAR) - 1e-9)
                if b - a < need:
                    continue
                low, high = places[a : b - need + 1], places[a + need - 1 : b]
                for p, q in zip(low[high - low < per].tolist(), high[high - low < per].tolist(), strict=True):
                    starts.setdefault(size, set()).update(range(max(0, q - per + 1), min(p, len(tokens) - size) + 1))
        best: dict[int, tuple[float, int, int]] = {}
        for size, good in starts.items():
            for s in sorted(good):
                hashes = shingle_hashes(tokens[s : s + size])
                fp = int(fingerprint(signs(hashes).sum(axis=0, keepdims=True))[0])
                own = Counter(hashes)
                for i in self.candidates(fp, size).tolist():
                    sim = similarity(own, self.counts[i])
                    if sim >= SIMILAR and (i not in best or (-sim, s) < (-best[i][0], best[i][1])):
                        best[i] = (sim, s, size)
        whole = Counter(shingle_hashes(tokens)) if longer else None
        for i in longer:
            sim = similarity(whole, self.counts[i])
            if sim >= SIMILAR:
                best[i] = (sim, 0, len(tokens))
        return [(self.ids[i], s, size, sim) for i, (sim, s, size) in sorted(best.items())]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, start, n_words and similarity for every document and item that match."""
    return marked_matches(docs, benchmark, id_col, text_col, item_col, block_bytes).drop("own")


def marked_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """contaminated() with own, which tells texts under one id apart."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("own"), F.col(text_col).alias("text"))
    names = ("doc_id", "own", "item_id", "start", "n_words", "similarity")
    kinds = (*[pa.int64()] * 5, pa.float64())
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part])

        def run(batches, held=held):
            index = Index(held.value)
            for batch in batches:
                rows = []
                for doc_id, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    rows += [(doc_id, own, *m) for m in index.matches(text.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

        out = chosen.mapInArrow(run, "doc_id long, own long, item_id long, start long, n_words long, similarity double")
        found = out if found is None else found.unionByName(out)
    return found


def op5_simhash_windows(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
