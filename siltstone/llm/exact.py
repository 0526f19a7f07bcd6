"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after all ASCII white space is deleted; a null text counts as empty. The first scan
computes only length and prefix hash, which meet in one exchange of two numbers a row. What has a partner there
survives; the survivors' keys go into a bitmap of fixed size, so the second scan can tell on the spot which texts
deserve a full hash. A false hit of the bitmap costs one needless hash and changes no result. Texts never enter an
exchange.

Defined cases: null and empty texts are equal to each other; an empty table gives no rows; rows that repeat both the
id and the text count as one document read twice and share one decision; a null id is smaller than any other; of equal
texts with one id and as many code points that differ in white space, the one with the smallest hash stays; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

#: Bits of the survivors' bitmap: 2**24 bits are at most 262,144 words, about 4 MB wherever it is broadcast.
BITMAP_BITS = 1 << 24
PREFIX_CHARS = 256


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _slot(length: Column, prefix: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(bits))


def equal_text_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False, bits: int = BITMAP_BITS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (null where no full hash was needed).

    Of equal texts the one with the most code points stays, then the smallest id. hash_all asks for the full hash of
    every row, for callers that report it.
    """
    return _decided(docs, id_col, text_col, hash_all, bits).drop("own")


def _own(text: Column) -> Column:
    """Tells texts under one id apart, white space included."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _decided(docs: DataFrame, id_col: str, text_col: str, hash_all: bool = False, bits: int = BITMAP_BITS) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).withColumn(
        "__norm", without_space(F.col("__text"))
    )
    base = base.select(
        "doc_id",
        _own(F.col("__text")).alias("own"),
        F.length(F.coalesce("__text", F.lit(""))).alias("n_chars"),
        F.octet_length("__norm").alias("length"),
        F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("prefix"),
        "__norm",
    )
    surviving = base.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slot = _slot(F.col("length"), F.col("prefix"), bits)
    words = surviving.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("word"))
    bitmap = staged(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("mask")), "exact-bitmap")
    marked = base.withColumn("s", slot).withColumn("word", F.expr("s div 64"))
    # at most bits / 64 rows of two numbers, whatever the input
    marked = marked.join(F.broadcast(bitmap), "word", "left")
    survives = F.expr("coalesce(shiftright(mask, cast(s % 64 as int)) & 1L, 0L) = 1L")
    full = F.sha2("__norm", 256)
    hashed = staged(
        marked.select(
            "doc_id",
            "own",
            "n_chars",
            survives.alias("survives"),
            (full if hash_all else F.when(survives, full)).alias("text_sha256"),
        ),
        "exact-hashed",
    )
    # written, so that both sides of the join below are dealt anew and a hot group of copies can be split
    groups = staged(
        hashed.filter("survives")
        .groupBy("text_sha256")
        .agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "own")).alias("best"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("text_sha256").alias("key"), F.col("best.doc_id").alias("keep_id"), "n", F.col("best.less").alias("less"), F.col("best.own").alias("keep_own")),
        "exact-groups",
    )
    copies = hashed.filter("survives").join(groups, F.col("text_sha256") == F.col("key"), "left")
    best = (F.col("n_chars") == -F.col("less")) & (F.col("own") == F.col("keep_own"))
    stays = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & best)
    copies = copies.select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        stays.alias("kept"),
        "text_sha256",
        "own",
    )
    alone = hashed.filter("not survives").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "own"
    )
    return copies.unionByName(alone)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the copies, columns unchanged. Only ids and hashes of the losers are joined back."""
    losers = _decided(docs, id_col, text_col).filter(~F.col("kept")).select("doc_id", "text_sha256", "own").distinct()
    # the hash of the text as it is keeps the row that stays from losers with its id; names are those of one side each
    losers = losers.alias("losers")
    kept = docs.alias("docs")
    same = kept[f"docs.{id_col}"].eqNullSafe(losers["losers.doc_id"]) & (_own(kept[f"docs.{text_col}"]) == losers["losers.own"])
    return kept.join(losers, same & (F.sha2(without_space(kept[f"docs.{text_col}"]), 256) == losers["losers.text_sha256"]), "left_anti")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return equal_text_groups(docs, hash_all=True)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
