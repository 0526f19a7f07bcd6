"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, and calibrated thresholds.

Two dictionaries are trained by zstandard's own trainer, one on windows of toxic and one on windows of ordinary labelled
text. Every window of a text is compressed with either; the bytes that the toxic dictionary saves over the ordinary one
are the window's distance. A window is one word: wider ones add the noise of their ordinary words to the distance.

Text is written for compression so that each letter takes LETTER_BYTES bytes, drawn from a hash of the word up to and
with that letter. A match then saves far more than its cost, and words match from their beginning, inflected forms
included.

Toxic documents are mostly ordinary text, so the first dictionaries share much. Each further round trains the toxic one
on the windows of toxic documents that it compresses better than the ordinary one does, and gives the ordinary one the
windows of ordinary documents where it lost, several times. How large the dictionaries are and how many rounds follow is
chosen from CANDIDATES by the log-loss on labelled documents whose windows trained no dictionary; there also the
threshold of a distant window is chosen and the logistic calibration fitted, over the greatest distance, the number and
the rate of distant windows, and the sum of the three greatest. Each class is weighted by its share of all labelled rows.

Labels are learned from a bounded sample, at most SAMPLE rows of each class, chosen by a hash of the id, from rows
whose crc32 of the id modulo 5 is not 0, and about WINDOWS windows of each class, chosen by a hash of id and place. Ids,
languages and sources are never inputs of a score.

Defined cases: a null, empty or wordless text gets the score of a text without distant windows; without labelled rows of both
classes every score is 0; several labels of one id count as toxic if one does; repeated rows score alike; other
columns are ignored; a text of any length is scored whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import staged

#: Labelled rows, and windows of text, of each class that are learned from, at most (windows: about).
SAMPLE = 10_000
WINDOWS = 200_000
FOLDS = 5
#: Of the learned documents one in so many calibrates; its windows train no dictionary.
CALIBRATES = 4
LETTER_BYTES, LETTERS = 8, 12
LEVEL = 3
#: Trainer's segment and d-mer sizes in bytes.
SEGMENT, DMER = 64, 8
#: (bytes of the ordinary dictionary, of the toxic one, further rounds, times that a lost ordinary window counts).
CANDIDATES = ((16384, 4096, 0, 0), (49152, 8192, 0, 0), (49152, 8192, 2, 2), (16384, 4096, 2, 8), (49152, 8192, 2, 8))
THRESHOLDS = (10, 14, 18, 22, 28)
MEMORY_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    distant: int = THRESHOLDS[0]
    weights: tuple[float, ...] = (0.0,) * 5


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def written(word: str) -> bytes:
    """The bytes that stand for a word: for each letter a hash of the word so far."""
    raw = word.encode("utf-8", "replace") if word.isascii() else None
    out = []
    for i in range(1, min(len(word), LETTERS) + 1):
        start = raw[:i] if raw is not None else word[:i].encode("utf-8", "replace")
        out.append(hashlib.blake2b(start, digest_size=LETTER_BYTES).digest())
    return b"".join(out)


def _trained(size: int, windows: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, windows, k=SEGMENT, d=DMER, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        # the trainer refuses very little text: then the text itself is the dictionary
        return b"".join(dict.fromkeys(windows))[-size:]


def _compressor(content: bytes):
    import zstandard

    settings = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if content:
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
        settings["dict_data"] = known
    return zstandard.ZstdCompressor(**settings).compress


class Distances:
    """The distance of windows under two dictionaries; those of frequent words are remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._toxic, self._ordinary = _compressor(toxic), _compressor(ordinary)
        self._memory: dict[str, int] = {}

    def of(self, word: str) -> int:
        window = written(word)
        return len(self._ordinary(window)) - len(self._toxic(window))

    def __call__(self, found: list[str]) -> list[int]:
        """The distances of a text's windows."""
        out = list(map(self._memory.get, found))
        if None in out:
            if len(self._memory) > MEMORY_WORDS:
                self._memory.clear()
            for i, d in enumerate(out):
                if d is None:
                    d = self._memory.get(found[i])
                    out[i] = self._memory[found[i]] = self.of(found[i]) if d is None else d
        return out


def train(toxic: list[str], ordinary: list[str], candidate: tuple[int, int, int, int]) -> tuple[bytes, bytes]:
    """Dictionaries of toxic and of ordinary windows (words)."""
    large, small, rounds, times = candidate
    memory: dict[str, bytes] = {}
    for w in (*toxic, *ordinary):
        if w not in memory:
            memory[w] = written(w)
    lost: list[str] = []
    won = toxic
    for n in range(rounds + 1):
        made = _trained(small, [memory[w] for w in won]), _trained(large, [memory[w] for w in (*ordinary, *lost)])
        if n < rounds:
            distance = Distances(*made)
            leans = {w: distance.of(w) > 0 for w in memory}
            lost = [w for w in ordinary if leans[w]] * times
            won = [w for w in toxic if leans[w]] or toxic
    return made


def features(found: list[int], distant: int) -> tuple[float, ...]:
    """What the calibration weighs, of the distances of a text's windows."""
    top = heapq.nlargest(3, found)
    many = sum(d >= distant for d in top)
    if many == 3:
        many = sum(d >= distant for d in found)
    return (top[0] / 16 if top else 0.0, math.log1p(many), math.log1p(100 * many / (len(found) + 20)), sum(top) / 48)


def score_of(values: tuple[float, ...], weights: tuple[float, ...]) -> float:
    z = weights[0] + sum(a * b for a, b in zip(values, weights[1:], strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic weights with a small ridge, and the log-loss; n: the weight of each row."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 1e-2 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return tuple(w.tolist()), float(-(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / n.sum())


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _window_rows(texts: DataFrame) -> DataFrame:
    """label, word, draw: every window of each text, the draw in [0, 2**32) from a hash of its text and place."""

    def run(batches):
        import xxhash

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = words(text)
                if not found:
                    continue
                seed = xxhash.xxh32_intdigest(text.encode("utf-8", "replace"))
                draw = ((np.arange(len(found), dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), label, np.int32)), pa.array(found, pa.string()), pa.array(draw.astype(np.int64))], names=["label", "word", "draw"]
                )

    return texts.select("label", "text").mapInArrow(run, "label int, word string, draw long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> Model:
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").cast("int").alias("label")).withColumn("draw", F.xxhash64("id"))
    known = staged(known, "toxicity-labels")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {y: n / sum(shares.values()) for y, n in shares.items()}
    sides = [known.filter(F.col("label") == y).orderBy("draw", "id").limit(sample) for y in (0, 1)]
    chosen = sides[0].unionByName(sides[1]).select("id", "label")
    # at most twice the bound of small rows, whatever the input
    learned = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # copies of a text would teach their own words
    learned = learned.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("label").alias("label"))
    learned = learned.withColumn("calibrates", F.pmod(F.xxhash64("text"), F.lit(CALIBRATES)) == 0)
    learned = staged(learned, "toxicity-sample")
    parts = {(r["label"], r["calibrates"]): r["n"] for r in learned.groupBy("label", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(any(parts.get((y, c)) for c in (True, False)) for y in (0, 1)):
        return Model(b"", b"")
    apart = all(parts.get((y, c)) for y in (0, 1) for c in (True, False))  # else too few documents to set some aside
    texts = learned.filter("not calibrates") if apart else learned
    rows = staged(_window_rows(texts), "toxicity-windows")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = {}
    for y in (0, 1):
        below = int(min(1.0, windows / max(1, totals.get(y, 0))) * (1 << 32))
        held = rows.filter((F.col("label") == y) & (F.col("draw") < below)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).toPandas()
        held = held.sort_values(["word"])
        # in an order of their own, so that no stretch of the sample is one word
        names = np.repeat(held["word"].to_numpy(dtype=object), held["n"].to_numpy(dtype=np.int64))
        drawn[y] = names[np.random.default_rng(7).permutation(len(names))].tolist()
    if not drawn[0] or not drawn[1]:
        return Model(b"", b"")
    made = [train(drawn[1], drawn[0], c) for c in CANDIDATES]
    measured = _measured(learned.filter("calibrates") if apart else learned, made).toPandas()
    best: tuple[float, Model] | None = None
    for i, (toxic, ordinary) in enumerate(made):
        for t in THRESHOLDS:
            own = measured[(measured["candidate"] == i) & (measured["distant"] == t)]
            x, y = own[[f"f{k}" for k in range(4)]].to_numpy(dtype=float), own["label"].to_numpy(dtype=float)
            n = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum())) * len(y)
            weights, loss = calibrated(x, y, n)
            if best is None or loss < best[0] - 1e-12:
                best = loss, Model(toxic, ordinary, t, weights)
    return best[1]


def _measured(texts: DataFrame, made: list[tuple[bytes, bytes]]) -> DataFrame:
    """The features of each text under each candidate and threshold: a bounded number of small rows."""
    names = ("candidate", "distant", "label", "f0", "f1", "f2", "f3")

    def run(batches):
        measures = [Distances(*m) for m in made]
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                for i, measure in enumerate(measures):
                    own = measure(found)
                    rows += [(i, t, label, *features(own, t)) for t in THRESHOLDS]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int32() if k < 3 else pa.float64()) for k, n in enumerate(names)})

    return texts.select("label", "text").mapInArrow(run, "candidate int, distant int, label int, f0 double, f1 double, f2 double, f3 double")


@functools.lru_cache(maxsize=2)
def _loaded(packed: bytes) -> tuple[Model, Distances]:
    model: Model = pickle.loads(packed)
    return model, Distances(model.toxic, model.ordinary)


def score(text: str | None, packed: bytes) -> float:
    model, distances = _loaded(packed)
    return score_of(features(distances(words(text)), model.distant), model.weights)


def scored(text: Column, model: Model) -> Column:
    """The score of a text as a column."""
    if not model.toxic:
        return F.lit(0.0)
    packed = pickle.dumps(model)

    @F.pandas_udf(T.DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([score(t, packed) for t in batch], dtype="float64")

    return run(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scored(F.col(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
