"""Corpus preparation from documents to packed training sequences.

Each stage reads what its predecessor kept, written as Parquet in the shared folder, and all but the last return the
columns of documents. Toxic documents go, then copies, then all but one of each group of near-duplicates, then
documents that hold a benchmark item; the rest is cut and packed into sequences.

What is lost is named by id and a hash of the text, so null and repeated ids take no other document along. Of a group of
near-duplicates the smallest id stays, a null id only where no document has one, and then the smallest hash of the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import decontaminate, exact, packing, simhash, toxicity
from siltstone.llm.scratch import staged


def drop_toxic(spark, docs, sf_dir):
    """Documents that score below 0.5 stay. A null or empty text scores like one without toxic windows; without labels of
    both classes all stay; repeated rows fare alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scored(docs["text"], model) < 0.5)


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the longest, then the one with the smallest id stays; null and empty texts are equal. Rows that
    repeat both id and text count as one document and stay or go together."""
    return exact.drop_copies(docs)


def without(docs, lost):
    """The documents whose id and text are not among the lost (doc_id, own)."""
    docs, lost = docs.alias("docs"), lost.select("doc_id", "own").alias("lost")
    same = docs["docs.doc_id"].eqNullSafe(lost["lost.doc_id"]) & (simhash.text_mark(docs["docs.text"]) == lost["lost.own"])
    return docs.join(lost, same, "left_anti")


def drop_near_copies(spark, docs, sf_dir):
    """The document with the smallest id of each group stays, rows that repeat its id and text included. Texts without
    words are near copies of each other."""
    return without(docs, simhash.near_copies(docs))


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go; null and empty texts hold none; an empty benchmark drops nothing."""
    found = decontaminate.marked_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, staged(found.select("doc_id", "own").distinct(), "contaminated"))


def pack(spark, docs, sf_dir):
    """A row for each piece of each document; a null or empty text has one piece, the end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express fingerprints of XXH64, trained dictionaries or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each on what the one before kept, written and read again. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
