"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many of the longest length as fit, then one
for each binary digit of the rest. Pieces of one length form a bucket, and a sequence of that length is one piece, so
no sequence crosses documents and none needs padding.

Sequences are numbered gaplessly, longest first; within a length by hash bucket and then by document. The numbers come
from counts by length and bucket, so no length is ever gathered in one task.

Defined cases: a null or empty text is the end id alone, a single piece of length 1; rows that repeat an id are pieces
of their own; an empty table gives no rows; other columns are ignored; a text of any length is cut whole.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .scratch import staged

LONGEST = 1024
#: Hash buckets for each length that number sequences side by side.
NUMBER_BUCKETS = 1024


def cuts(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, in order."""
    found = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at, rest = n - n % longest, n % longest
    for bit in range(longest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            found.append((at, 1 << bit))
            at += 1 << bit
    return found


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the packed ids if asked for."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = tokenizer or bpe.default_path()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def cut(batches):
        columns = tuple([] for _ in range(6))
        ids_of, starts, lengths, sums, totals, packed = columns
        for doc_id, ids in bpe.encoded(batches, path):
            n, view = len(ids) // 4, memoryview(ids)
            own = cuts(n, longest)
            for start, length in own:
                piece = view[4 * start : 4 * (start + length)]
                sums.append(zlib.crc32(piece))
                if with_ids:
                    packed.append(bytes(piece))
            ids_of += [doc_id] * len(own)
            totals += [n] * len(own)
            starts += [s for s, _ in own]
            lengths += [c for _, c in own]
            if len(starts) > 50_000 or with_ids and len(starts) * longest > 4_000_000:
                yield batch_of(columns)
                for c in columns:
                    c.clear()
        yield batch_of(columns)

    def batch_of(columns) -> pa.RecordBatch:
        held = {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=False)}
        if with_ids:
            held["ids"] = pa.array(columns[5], pa.binary())
        return pa.RecordBatch.from_pydict(held)

    schema = ", ".join(f"{n} long" for n in names) + (", ids binary" if with_ids else "")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, schema)


def pack(docs: DataFrame, buckets: int = NUMBER_BUCKETS, **options) -> DataFrame:
    """Pieces with their sequence_id and the offset there, which is always 0."""
    cut = staged(pieces(docs, **options).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")), "pieces")
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most a row for each length and bucket, whatever the input
    before = Window.orderBy(F.col("length").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    # a bounded table, so the pieces need no second exchange
    numbered = cut.withColumn("within", F.row_number().over(inside) - 1).join(F.broadcast(firsts), ["length", "bucket"])
    return numbered.select(
        *[c for c in cut.columns if c != "bucket"],
        (F.col("first") + F.col("within")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def op10_power_of_two_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
