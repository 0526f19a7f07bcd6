"""Token ids of a corpus as binary files with Elias-Fano coded document boundaries.

A shard file holds the ids of a range of documents one after another (16 bits an id where the vocabulary allows, else
32), then the document boundaries and the document ids, both Elias-Fano coded, then a footer that says where each part
lies. Boundaries are read by select, so no table of 64-bit offsets is kept on disk or in memory.

Documents are dealt to shards by ranges of their id and of a hash of their text, and sorted by both within each, so
shards in order give the corpus in ascending id order, and a repeated id is split like any other range. There are as
many shards as the input's bytes ask for, so what a writer holds (16 bytes a document) is bounded. A task writes under a name of its own and only a task that succeeds has its name in the manifest:
a lost executor leaves at most an unlisted file.

Defined cases: a null id comes first; documents with equal ids follow each other in the order of a hash of their text; ids are signed
64-bit; a null or empty text has only the end id; an empty table writes no file and gives no rows; other columns are
ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .elias_fano import EliasFano, encode
from .scratch import fresh_path, staged

FOOTER = struct.Struct("<QQQQQ4s4x")  # ids, documents, null ids, start of boundaries, start of document ids
MAGIC = b"EFT1"
SHIFT = np.uint64(1 << 63)
#: Bytes of text of a shard, about.
SHARD_BYTES = 128_000_000
#: Ids that a reader holds at a time.
READ_IDS = 4_000_000


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


class ShardWriter:
    """Writes one file; documents come in ascending order of id."""

    def __init__(self, folder: str, width: int):
        self._fs, base = _store(folder)
        self._fs.create_dir(base, recursive=True)
        self.name = f"tokens-{uuid.uuid4().hex}.eft"
        self._final, self._temporary = f"{base}/{self.name}", f"{base}/.{self.name}.part"
        self._out = self._fs.open_output_stream(self._temporary)
        self._kind = "<u2" if width == 2 else "<u4"
        self._lengths, self._keys = array("q"), array("q")
        self._nulls = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._out.write(np.frombuffer(ids, "<u4").astype(self._kind).tobytes())
        self._lengths.append(len(ids) // 4)
        if doc_id is None:
            self._nulls += 1
        else:
            self._keys.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        bounds = np.concatenate([[0], np.cumsum(np.array(self._lengths, dtype=np.int64))])
        total = int(bounds[-1])
        width = 2 if self._kind == "<u2" else 4
        edges = encode(bounds)
        keys = encode(np.array(self._keys, dtype=np.int64).view(np.uint64) + SHIFT)
        self._out.write(edges)
        self._out.write(keys)
        start = total * width
        self._out.write(FOOTER.pack(total, len(self._lengths), self._nulls, start, start + len(edges), MAGIC))
        self._out.close()
        self._fs.move(self._temporary, self._final)
        return self.name, len(self._lengths), total


class ShardReader:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str):
        fs, base = _store(folder)
        self._file = fs.open_input_file(f"{base}/{name}")
        size = self._file.size()
        self.ids, self.documents, self.nulls, at, keys_at, magic = FOOTER.unpack(self._range(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.width = at // self.ids if self.ids else 4
        self.bounds = EliasFano(self._range(at, keys_at - at))
        self.keys = EliasFano(self._range(keys_at, size - FOOTER.size - keys_at))

    def _range(self, start: int, length: int) -> bytes:
        self._file.seek(start)
        return self._file.read(length)

    def span(self, start: int, stop: int) -> np.ndarray:
        raw = self._range(start * self.width, (stop - start) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.span(self.bounds.select(i), self.bounds.select(i + 1))

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls) - (1 << 63)

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start within the file, ids) of each document, holding about READ_IDS ids at a time."""
        step = max(1, int(READ_IDS / max(1.0, self.ids / max(1, self.documents))))
        for at in range(0, self.documents, step):
            edges = self.bounds.slice(at, min(at + step, self.documents) + 1).astype(np.int64)
            low = max(at, self.nulls)
            keys = self.keys.slice(low - self.nulls, at + len(edges) - 1 - self.nulls)
            names = [None] * (low - at) + [int(k) - (1 << 63) for k in keys]
            block = self.span(int(edges[0]), int(edges[-1]))
            for name, a, b in zip(names, edges[:-1], edges[1:], strict=True):
                yield name, int(a), block[a - edges[0] : b - edges[0]]

    def close(self) -> None:
        self._file.close()


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the files and return the staged manifest: shard, path, documents, ids and the ids of all shards before."""
    path = tokenizer or bpe.default_path()
    with open(path, encoding="utf-8") as f:
        width = 2 if max(json.load(f)["model"]["vocab"].values()) < 1 << 16 else 4

    def tokenised(batches):
        writer, first = None, None
        for doc_id, ids in bpe.encoded(batches, path):
            if writer is None:
                writer, first = ShardWriter(folder, width), doc_id
            writer.add(doc_id, ids)
        if writer:
            name, documents, ids = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [name], "documents": [documents], "ids": [ids], "first": pa.array([first], pa.int64())}
            )

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = ordered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    ordered = ordered.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    ordered = ordered.repartitionByRange(shards, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    listed = ordered.mapInArrow(tokenised, "path string, documents long, ids long, first long")
    listed = listed.select("*", F.spark_partition_id().alias("part"))
    listed = staged(listed, "token-manifest")
    # one row a shard: a list that is small beside the files it names
    order = Window.orderBy("part")
    return listed.select(
        "path",
        "documents",
        "ids",
        F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"),
    )


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def scanned(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows = ShardReader(folder, name), []
                for doc_id, start, ids in reader.scan():
                    rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                reader.close()
                yield _rows(rows)

    files = manifest.select("path", "before")
    # as many tasks as files: the list is a few bytes, what the tasks read is not
    files = files.repartition(max(1, manifest.count()))
    return files.mapInArrow(scanned, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
