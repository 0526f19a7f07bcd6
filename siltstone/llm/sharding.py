"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight from a hash of the
document id and the child's own path; the least draw wins, so a child is taken in proportion to its weight. A child's
draw depends on nothing but its own path and weight: if a weight grows, documents move only into that subtree, if it
shrinks, only out of it. A shard added by `grown` opens a region of its own, so it takes documents only into itself.

Law: `key` - the id and the topology decide. Everything is built-in functions: hashing is arithmetic modulo 2**31 - 1.

Defined cases: a null id is placed like id 0; a null text has size 1 and checksum 0; equal ids with equal texts are
interchangeable in their slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

P = (1 << 31) - 1
#: Buckets that number each shard's documents side by side. Shards times buckets bounds the table of counts.
SLOT_BUCKETS = 1024
SLOT_SALT = 424242


@dataclass(frozen=True)
class Node:
    path: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1

    @property
    def salt(self) -> int:
        return zlib.crc32(self.path.encode()) % P


@dataclass(frozen=True)
class Topology:
    """A tree of exactly three levels: regions, racks, shards."""

    regions: tuple[Node, ...]

    @staticmethod
    def build(shards: int, regions: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> "Topology":
        """Shards dealt over regions and racks in turn; every shard weighs 1 unless `weights` says otherwise."""
        if shards < 1:
            raise ValueError("a topology needs a shard")
        tree: dict[int, dict[int, list[Node]]] = {}
        for s in range(shards):
            r, k = s % regions, s // regions % racks
            leaf = Node(f"region-{r}/rack-{k}/shard-{s}", float((weights or {}).get(s, 1.0)), (), s)
            tree.setdefault(r, {}).setdefault(k, []).append(leaf)
        return Topology(tuple(_group(f"region-{r}", [_group(f"region-{r}/rack-{k}", v) for k, v in ks.items()]) for r, ks in tree.items()))

    @property
    def shards(self) -> list[int]:
        return [s.shard for r in self.regions for k in r.children for s in k.children]

    def grown(self, weight: float = 1.0) -> "Topology":
        """One more shard, numbered after the last, in a region of its own."""
        new = max(self.shards) + 1
        leaf = Node(f"region-of-{new}/rack-0/shard-{new}", float(weight), (), new)
        return Topology((*self.regions, _group(f"region-of-{new}", [_group(f"region-of-{new}/rack-0", [leaf])])))


def _group(path: str, children: list[Node]) -> Node:
    return Node(path, sum(c.weight for c in children), tuple(children))


_CHILD = "array<struct<salt:bigint,weight:double,at:int>>"


def mixed(x: Column, salt: Column) -> Column:
    """A hash of a long, in [0, 2**31 - 1), from multiplication, addition, xor and shift alone."""
    h = (F.pmod(x, F.lit(P)) * 48271 + F.pmod(F.shiftright(x, 31), F.lit(P)) * 69621 + salt) % P
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * 1103515245 + 12345) % P
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * 1664525 + 1013904223) % P
    return (h.bitwiseXOR(F.shiftright(h, 16)) * 214013 + 2531011) % P


def _children(nodes: list[Node], numbers: dict[str, int]) -> Column:
    rows = ", ".join(f"named_struct('salt', {n.salt}L, 'weight', {n.weight!r}D, 'at', {numbers[n.path]})" for n in nodes)
    return F.expr(f"array({rows})")


def _draw(key: Column, children: Column) -> Column:
    tries = F.transform(
        children, lambda c: F.struct((-F.log((mixed(key, c["salt"]) + 0.5) / F.lit(float(P))) / c["weight"]).alias("draw"), c["at"].alias("at"))
    )
    return F.array_min(tries)["at"]


def place(key: Column, topology: Topology) -> Column:
    """The shard of a document id."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    level, chosen = list(topology.regions), None
    families: list[list[Node]] = [level]
    for depth in range(3):
        members = [n for family in families for n in family]
        numbers = {n.path: n.shard if depth == 2 else i for i, n in enumerate(members)}
        if chosen is None:
            options = _children(families[0], numbers)
        else:
            options = F.element_at(F.array(*[_children(f, numbers) for f in families]), chosen + 1)
        chosen = _draw(key, options)
        families = [list(n.children) for n in members]
    return chosen


def assign(docs: DataFrame, topology: Topology, id_col: str = "doc_id", text_col: str = "text", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and the gapless slot within the shard.

    Slots come from two steps that never gather a shard in one task: counts by shard and hash bucket, added up over
    the buckets, and the row's number within its bucket. The counting step reads the id column alone.
    """
    key = F.col("doc_id")
    bucket = F.pmod(mixed(F.coalesce(key, F.lit(0).cast("long")), F.lit(SLOT_SALT).cast("long")), F.lit(buckets)).cast("int")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    placed = ids.select("doc_id", place(key, topology).alias("shard"), bucket.alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    body = F.encode(F.coalesce("__text", F.lit("")), "UTF-8")
    rows = ids.select(
        "doc_id",
        (F.coalesce(F.octet_length("__text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        place(key, topology).alias("shard"),
        place(key, topology.grown()).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("within", F.row_number().over(inside) - 1)
    return rows.join(offsets, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast(T.IntegerType()).alias("shard"),
        (F.col("first") + F.col("within")).cast("long").alias("slot"),
        F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard"),
    )


def op1_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), Topology.build(16))


def _sql_mixed(x: str, salt: str) -> str:
    first = f"(({x} % {P}) * 48271 + (({x} >> 31) % {P}) * 69621 + {salt}) % {P}"
    for shift, times, plus in ((15, 1103515245, 12345), (13, 1664525, 1013904223), (16, 214013, 2531011)):
        first = f"list_transform([{first}], lambda h: (xor(h, h >> {shift}) * {times} + {plus}) % {P})[1]"
    return first


def _sql_place(topology: Topology) -> str:
    """One CTE a level: every child's draw beside the document, the least wins."""
    def table(nodes: list[tuple[str, Node]]) -> str:
        return ", ".join(f"('{parent}', '{n.path}', {n.salt}::BIGINT, {n.weight!r}::DOUBLE, {n.shard})" for parent, n in nodes)

    level = [("", r) for r in topology.regions]
    racks = [(r.path, k) for r in topology.regions for k in r.children]
    leaves = [(k.path, s) for _, k in racks for s in k.children]
    return table([*level, *racks, *leaves])


def oracle() -> str:
    now = Topology.build(16)
    draw = f"-ln(({_sql_mixed('d.doc_id', 'n.salt')} + 0.5) / {float(P)}) / n.weight"
    steps = []
    for name, tree in (("now", now), ("then", now.grown())):
        steps.append(f"tree_{name}(parent, path, salt, weight, shard) AS (VALUES {_sql_place(tree)})")
        last = "(SELECT doc_id, '' AS path FROM documents)"
        for depth in range(3):
            steps.append(
                f"{name}{depth} AS (SELECT d.doc_id, arg_min(n.path, {draw}) AS path, arg_min(n.shard, {draw}) AS shard"
                f" FROM {last} d JOIN tree_{name} n ON n.parent = d.path GROUP BY d.doc_id)"
            )
            last = f"{name}{depth}"
    table = ", ".join(str(v) for v in _CRC_TABLE)
    return f"""WITH {', '.join(steps)},
    raw AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
    crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2),
        lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, ([{table}]::BIGINT[])[(xor(c, b) & 255::BIGINT) + 1])), 4294967295) AS text_crc32 FROM raw)
    SELECT c.doc_id, c.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
      row_number() OVER (PARTITION BY a.shard ORDER BY ({_sql_mixed('c.doc_id', str(SLOT_SALT))}) % {SLOT_BUCKETS}, c.doc_id) - 1 AS slot,
      b.shard::INTEGER AS grown_shard
    FROM crc c JOIN now2 a USING (doc_id) JOIN then2 b USING (doc_id)"""


def _crc_row(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
    return n


_CRC_TABLE = [_crc_row(n) for n in range(256)]
