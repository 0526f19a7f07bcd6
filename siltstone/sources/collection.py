"""Collections on a Hadoop file system: an append-only log, folded segments, and a manifest that names both.

Data files never change. A commit writes a log folder and then the next manifest, a small JSON file under the next
version number created without overwriting, so of two writers one fails and retries. Readers take the latest manifest
(strong) or keep the one they have (eventual).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, Invalid, NotFound, Overloaded, Unavailable
from ..operators import filters, mutate
from ..operators.inverted import InvertedIndex
from ..operators.ivf import IvfIndex
from ..schema import Schema, check_name
from . import rows as row_source

ATTEMPTS = 100
#: Bytes of unfolded log beyond which writes are refused and beyond which a strong read is.
WRITE_LIMIT, READ_LIMIT = 64 << 20, 128 << 20
COMPACT_BYTES, COMPACT_ENTRIES = 8 << 20, 32
GRACE_SECONDS = 3600


@dataclass
class Manifest:
    version: int = 0
    next_seq: int = 1
    log: list[dict[str, Any]] = field(default_factory=list)
    segment: str | None = None
    segment_rows: int = 0
    index: str | None = None
    inverted: str | None = None
    #: Log entries folded into the segment since the indexes were built, which hold neither them nor what they replaced.
    folded: list[dict[str, Any]] = field(default_factory=list)
    schema: Schema = field(default_factory=Schema)
    created: float = 0.0
    updated: float = 0.0
    #: The last batch taken of each source that numbers its batches.
    sources: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"schema": self.schema.to_json()})

    @classmethod
    def from_json(cls, raw: str) -> Manifest:
        found = json.loads(raw)
        return cls(**found | {"schema": Schema.from_json(found["schema"])})

    def files(self) -> set[str]:
        return {e["path"] for e in self.log + self.folded} | {p for p in (self.segment, self.index, self.inverted) if p}


class Collection:
    """One collection under root/name."""

    def __init__(self, spark: SparkSession, root: str, name: str, embedder: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.root, self.name, self.embedder = spark, root.rstrip("/"), check_name(name), embedder
        self.path = f"{self.root}/{name}"
        self._jvm = spark.sparkContext._jvm
        self._known: Manifest | None = None

    # ------------------------------------------------------------ files

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, float]]:
        path = self._hadoop(f"{self.path}/{folder}" if folder else self.path)
        if not self._fs.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(path)]

    def _latest(self) -> int:
        return max((int(n.split(".")[0]) for n, _ in self._names("manifest") if n.endswith(".json")), default=0)

    def manifest(self, eventual_seconds: float = 0.0) -> Manifest:
        """The latest manifest, or the one held if it is young enough."""
        if self._known and eventual_seconds and time.time() - self._known_at <= eventual_seconds:
            return self._known
        version = self._latest()
        if not version:
            return Manifest()
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{version:012d}.json"))
        try:
            raw = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        self._known, self._known_at = Manifest.from_json(raw), time.time()
        return self._known

    def _publish(self, manifest: Manifest) -> bool:
        """False if another writer took the version."""
        manifest.version += 1
        manifest.updated = time.time()
        manifest.created = manifest.created or manifest.updated
        final = self._hadoop(f"{self.path}/manifest/{manifest.version:012d}.json")
        temporary = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        self._fs.mkdirs(temporary.getParent())
        out = self._fs.create(temporary, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        # createNonRecursive without overwrite decides between writers; the content is moved in under that lock
        lock = self._hadoop(f"{self.path}/manifest/.{manifest.version:012d}.lock")
        try:
            self._fs.create(lock, False).close()
        except Exception:  # noqa: BLE001  the file system's own kind of "already exists"
            self._fs.delete(temporary, False)
            return False
        return bool(self._fs.rename(temporary, final))

    def _commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        for _ in range(ATTEMPTS):
            new = change(Manifest.from_json(self.manifest().to_json()))
            if self._publish(new):
                return new
            time.sleep(0.01)
        raise Conflict(f"{ATTEMPTS} attempts to commit to {self.name!r} met other writers")

    def exists(self) -> bool:
        return self._latest() > 0

    def _required(self) -> Manifest:
        found = self.manifest()
        if not found.version:
            raise NotFound(f"no collection {self.name!r}")
        return found

    # ------------------------------------------------------------ reading

    def log_bytes(self, manifest: Manifest | None = None) -> int:
        return sum(e["bytes"] for e in (manifest or self.manifest()).log)

    def live(self, eventual_seconds: float = 0.0) -> DataFrame:
        """The live rows: segment and log folded. Eventual reads take the longest prefix of the log within the limit."""
        manifest = self.manifest(eventual_seconds)
        entries = self._visible(manifest, eventual_seconds)
        return mutate.fold(self._entries(manifest, entries)) if entries else self._segment(manifest)

    def tail(self, eventual_seconds: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
        """What was written since the indexes were built: the ids touched, their live rows, and the number of entries."""
        manifest = self.manifest(eventual_seconds)
        entries = self._visible(manifest, eventual_seconds)
        late = manifest.folded + entries
        changed = self.spark.read.schema(manifest.schema.struct()).parquet(*[f"{self.path}/{e['path']}" for e in late]).select("id").distinct()
        base = self._segment(manifest).join(changed, "id", "left_semi")
        rows = mutate.fold(self._with_base(base, self._log(manifest, entries))) if entries else base
        return changed, rows, sum(e["rows"] for e in late)

    def _visible(self, manifest: Manifest, eventual_seconds: float) -> list[dict[str, Any]]:
        if not manifest.version:
            raise NotFound(f"no collection {self.name!r}")
        entries, held = [], 0
        for entry in manifest.log:
            held += entry["bytes"]
            if held > READ_LIMIT:
                if not eventual_seconds:
                    raise Unavailable("too much unfolded log for a consistent read; compact first")
                break
            entries.append(entry)
        return entries

    def segment(self, manifest: Manifest | None = None) -> DataFrame:
        """The rows of the last compaction; the indexes are of these, apart from what was folded in since they were built."""
        return self._segment(manifest or self._required())

    def _segment(self, manifest: Manifest) -> DataFrame:
        schema = manifest.schema.struct()
        if not manifest.segment:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{manifest.segment}")

    def _log(self, manifest: Manifest, entries: list[dict[str, Any]]) -> DataFrame:
        """Log rows in order; where an entry stands is in the manifest, so its files need not be written again for it."""
        kind = T.StructType([*manifest.schema.struct().fields, *LOG_FIELDS])
        log = self.spark.read.schema(kind).parquet(*[f"{self.path}/{e['path']}" for e in entries])
        numbers = F.create_map(*[F.lit(x) for e in entries for x in (e["path"].rpartition("/")[2], e["seq"])])
        own = F.element_at(numbers, F.regexp_extract(F.col("_metadata.file_path"), "/log/([0-9a-f]{32})/", 1)).cast("long")
        return log.withColumn("ord", F.struct(own.alias("seq"), F.col("pos"))).drop("pos")

    def _entries(self, manifest: Manifest, entries: list[dict[str, Any]]) -> DataFrame:
        log = self._log(manifest, entries)
        return self._with_base(self._segment(manifest), log) if manifest.segment else log

    @staticmethod
    def _with_base(rows: DataFrame, log: DataFrame) -> DataFrame:
        base = rows.withColumn("op", F.lit("U")).withColumn("touched", F.lit(None).cast("array<string>"))
        return base.withColumn("ord", F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("pos"))).unionByName(log)

    # ------------------------------------------------------------ writing

    def write(self, request: dict[str, Any]) -> dict[str, int]:
        """One request of any mix of writes; filters see the state before it. Returns what it did, by kind."""
        known = {"upsert_rows", "upsert_columns", "patch_rows", "patch_columns", "deletes", "delete_by_filter", "patch_by_filter", "distance_metric", "schema", "sharding"}
        if unknown := set(request) - known:
            raise Invalid(f"unknown fields {sorted(unknown)}")
        if self.exists() and self.log_bytes() > WRITE_LIMIT:
            raise Overloaded("too much unfolded log; compact and retry")
        declared = declarations(request)
        upsert = row_source.from_columns(request["upsert_columns"]) if request.get("upsert_columns") else []
        upsert += row_source.checked(request.get("upsert_rows") or [])
        patch = row_source.from_columns(request["patch_columns"]) if request.get("patch_columns") else []
        patch += row_source.checked(request.get("patch_rows") or [])
        if any("vector" in r for r in patch):
            raise Invalid("a patch cannot change the vector")
        counts: dict[str, int] = {}
        entries: list[tuple[str, dict[str, Any], list[str] | None]] = []
        state = self.live() if self.exists() else None
        schema = self.manifest().schema
        # ids that filters find go from the live rows to a log entry without passing through the driver
        found: list[tuple[str, str, dict[str, Any]]] = []
        if request.get("delete_by_filter") is not None:
            found.append(("D", self._matches(state, request["delete_by_filter"], mutate.DELETE_CAP, schema, "deleted", counts), {}))
        if request.get("patch_by_filter") is not None:
            change = request["patch_by_filter"].get("patch") or {}
            if not change or {"id", "vector"} & set(change):
                raise Invalid("patch_by_filter needs a patch of attributes")
            ids = self._matches(state, request["patch_by_filter"].get("filters"), mutate.PATCH_CAP, schema, "patched", counts)
            found.append(("P", ids, change))
        self._embed(upsert, declared.get("embed") or schema.embed)
        entries += [("U", r, None) for r in upsert]
        entries += [("P", r, sorted(set(r) - {"id"})) for r in patch]
        entries += [("D", {"id": i}, None) for i in request.get("deletes") or []]
        for name, n in (("upserted", len(upsert)), ("patched", len(patch)), ("deleted", len(request.get("deletes") or []))):
            if n:
                counts[name] = counts.get(name, 0) + n
        counts["affected"] = sum(counts.get(k, 0) for k in ("upserted", "patched", "deleted"))
        self._append_rows(entries, declared, [x for x in found if x[1]])
        return counts

    def _matches(self, state, filter, cap, schema, name: str, counts: dict[str, int]) -> str | None:
        """The path of a table of the ids that a filter keeps, at most cap of them, the smallest first."""
        if state is None:
            counts[name] = 0
            return None
        path = f"{self.path}/matches/{uuid.uuid4().hex}"
        mutate.matching_ids(state, filter, cap, schema).write.parquet(path)
        counts[name] = self.spark.read.parquet(path).count()
        if counts[name] == cap and filters.apply(state, filter, schema).limit(cap + 1).count() > cap:
            counts["rows_remaining"] = 1
        return path if counts[name] else None

    def _embed(self, rows: list[dict[str, Any]], embed: dict[str, str]) -> None:
        """Vectors for rows that have none, from the first embedded attribute that they hold; one call for all."""
        waiting = [(r, next((r[a] for a in embed if isinstance(r.get(a), str)), None)) for r in rows if r.get("vector") is None]
        waiting = [(r, t) for r, t in waiting if t is not None]
        if not waiting:
            return
        if self.embedder is None:
            raise Invalid("rows need an embedding, and no embedder is configured")
        for (row, _), found in zip(waiting, self.embedder([t for _, t in waiting]), strict=True):
            row["vector"] = found

    def _append_rows(self, entries, declared: dict[str, Any], found) -> None:
        """One log entry of what filters found (op, path of ids, change), then the rows of the request in their order."""
        path, written = f"log/{uuid.uuid4().hex}", None

        def change(manifest: Manifest) -> Manifest:
            nonlocal written
            schema = manifest.schema.declare(**declared)
            changes = [c for _, _, c in found]
            schema, rows = schema.absorb([r for _, r, _ in entries] + [{"id": "" if schema.id_type in ("string", "uuid") else 0} | c for c in changes if c])
            manifest.schema = schema
            if not entries and not found:
                return manifest
            kind = T.StructType([*schema.struct().fields, *LOG_FIELDS])
            if written != (kind, rows):  # the first time, or if another writer changed what the values become
                data = [
                    tuple(row.get(f.name) for f in kind[: -len(LOG_FIELDS)]) + (len(found) + pos, op, touched)
                    for pos, ((op, _, touched), row) in enumerate(zip(entries, rows, strict=False))
                ]
                log = self.spark.createDataFrame(data, kind).coalesce(1)
                coerced = iter(rows[len(entries) :])
                for pos, (op, ids, own) in enumerate(found):
                    one = next(coerced) if own else {}
                    names = [f for f in kind[1 : -len(LOG_FIELDS)]]
                    values = [F.lit(one.get(f.name)).cast(f.dataType).alias(f.name) for f in names]
                    touched = F.array(*[F.lit(n) for n in sorted(own)]) if own else F.lit(None)
                    log = log.unionByName(self.spark.read.parquet(ids).select(F.col("id").cast(kind["id"].dataType), *values, F.lit(pos).cast("long").alias("pos"), F.lit(op).alias("op"), touched.cast("array<string>").alias("touched")))
                log.write.mode("overwrite").parquet(f"{self.path}/{path}")
                written = kind, rows
            manifest.log.append({"seq": manifest.next_seq, "path": path, "bytes": self._size(path), "rows": self._rows(path)})
            manifest.next_seq += 1
            return manifest

        self._commit(change)
        for _, ids, _ in found:
            self._fs.delete(self._hadoop(ids), True)

    def _rows(self, path: str) -> int:
        return self.spark.read.parquet(f"{self.path}/{path}").count()

    def _size(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._hadoop(f"{self.path}/{path}")).getLength())

    def append(self, log: DataFrame, schema: Schema | None = None, source: tuple[str, int] | None = None) -> None:
        """Commit a frame of log entries (id, pos, op, touched and typed columns) as one entry, however large.

        source names where the entries come from and numbers the batch: one that was taken before is not taken again.
        Used for batch and streaming ingest: nothing passes through the driver. A log that grows beyond WRITE_LIMIT is
        folded at once.
        """
        if source and self.manifest().sources.get(source[0], -1) >= source[1]:
            return
        path, written = f"log/{uuid.uuid4().hex}", None
        found = schema or Schema.of(log.drop("op", "pos", "touched", "ord"))
        id_type = "uint" if isinstance(log.schema["id"].dataType, (T.LongType, T.IntegerType)) else "string"

        def change(manifest: Manifest) -> Manifest:
            nonlocal written
            if source:
                if manifest.sources.get(source[0], -1) >= source[1]:
                    return manifest
                manifest.sources[source[0]] = source[1]
            new = manifest.schema.declare(types=found.types)
            manifest.schema = Schema(**new.__dict__ | {"id_type": new.id_type or id_type, "started": True})
            kind = manifest.schema.struct()
            columns = [(F.col(f"`{f.name}`") if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]
            if written != kind:
                rows = log.select(*columns, F.col("pos").cast("long").alias("pos"), "op", "touched")
                rows.write.mode("overwrite").parquet(f"{self.path}/{path}")
                written = kind
            manifest.log.append({"seq": manifest.next_seq, "path": path, "bytes": self._size(path), "rows": self._rows(path)})
            manifest.next_seq += 1
            return manifest

        if self.log_bytes(self._commit(change)) > WRITE_LIMIT:
            self.compact(build_index=False)

    # ------------------------------------------------------------ upkeep

    def needs_compaction(self) -> bool:
        manifest = self.manifest()
        return len(manifest.log) >= COMPACT_ENTRIES or self.log_bytes(manifest) >= COMPACT_BYTES

    def compact(self, build_index: bool = True) -> Manifest:
        """Fold the log into a new segment, sorted by id within shards, and rebuild the vector index and the inverted lists.

        Without build_index both stay as they are: searches go on reading them, with their statistics, beside the rows
        folded in since, so that what they find does not depend on when a log grew too large.
        """
        before = self._required()
        entries = list(before.log)
        path = f"segments/{uuid.uuid4().hex}"
        rows = mutate.fold(self._entries(before, entries)) if entries else self._segment(before)
        shards = max(1, before.schema.shards)
        if shards > 1:
            rows = rows.repartition(shards, mutate.shard_of(F.col("id"), shards))
        rows.sortWithinPartitions("id").write.parquet(f"{self.path}/{path}")
        held = self.spark.read.schema(before.schema.struct()).parquet(f"{self.path}/{path}")
        count, index = held.count(), None
        if build_index and held.filter(F.col("vector").isNotNull()).limit(1).count():
            index = f"index/{uuid.uuid4().hex}"
            IvfIndex.build(held, f"{self.path}/{index}", before.schema.metric)
        inverted = f"index/{uuid.uuid4().hex}" if build_index else None
        if inverted and InvertedIndex.build(held, f"{self.path}/{inverted}", before.schema, self._size(path)) is None:
            inverted = None
        folded, late = {e["path"] for e in entries}, []
        if not build_index and (before.index or before.inverted):
            index, inverted, late = before.index, before.inverted, before.folded + entries

        def change(manifest: Manifest) -> Manifest:
            if manifest.segment != before.segment:
                raise Conflict("another compaction came first")
            manifest.log = [e for e in manifest.log if e["path"] not in folded]
            manifest.segment, manifest.segment_rows, manifest.index, manifest.inverted = path, count, index, inverted
            manifest.folded = late
            return manifest

        return self._commit(change)

    def index(self, manifest: Manifest | None = None) -> IvfIndex | None:
        manifest = manifest or self._required()
        return IvfIndex.load(self.spark, f"{self.path}/{manifest.index}") if manifest.index else None

    def inverted(self, manifest: Manifest | None = None) -> InvertedIndex | None:
        manifest = manifest or self._required()
        return InvertedIndex.load(self.spark, f"{self.path}/{manifest.inverted}") if manifest.inverted else None

    def gc(self, grace_seconds: float = GRACE_SECONDS) -> int:
        """Delete data that no manifest names and that is older than the grace period; old manifests go too."""
        manifest, gone, now = self._required(), 0, time.time()
        used = manifest.files()
        for folder in ("log", "segments", "index", "matches"):
            for name, at in self._names(folder):
                if f"{folder}/{name}" not in used and now - at >= grace_seconds:
                    gone += bool(self._fs.delete(self._hadoop(f"{self.path}/{folder}/{name}"), True))
        for name, at in self._names("manifest"):
            if name.endswith(".json") and int(name.split(".")[0]) < manifest.version and now - at >= grace_seconds:
                self._fs.delete(self._hadoop(f"{self.path}/manifest/{name}"), False)
        return gone

    def branch(self, name: str) -> Collection:
        """A copy as of now under another name, which must be free. The manifest comes last."""
        manifest, other = self._required(), Collection(self.spark, self.root, name, self.embedder)
        if other.exists():
            raise Conflict(f"{name!r} exists")
        util, conf = self._jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in sorted(manifest.files()):
            target = self._hadoop(f"{other.path}/{path}")
            self._fs.mkdirs(target.getParent())
            util.copy(self._fs, self._hadoop(f"{self.path}/{path}"), self._fs, target, False, conf)
        copy = Manifest.from_json(manifest.to_json())
        copy.version, copy.created = 0, 0.0
        if not other._publish(copy):
            raise Conflict(f"{name!r} exists")
        return other

    def destroy(self) -> bool:
        return bool(self._fs.delete(self._hadoop(self.path), True))

    def metadata(self) -> dict[str, Any]:
        """Sizes and schema from the manifest alone."""
        m = self._required()
        return {"name": self.name, "schema": m.schema.to_json(), "segment_rows": m.segment_rows, "log_entries": len(m.log), "unindexed_bytes": sum(e["bytes"] for e in m.log + m.folded), "indexed": m.index is not None, "created": m.created, "updated": m.updated}

    def warm(self) -> int:
        """Keep the segment in memory where there is room."""
        held = self._segment(self._required()).persist()
        return held.count()

    def query(self, request: dict[str, Any]):
        from ..plans.request import execute

        return execute(self, request)


LOG_FIELDS = [T.StructField("pos", T.LongType()), T.StructField("op", T.StringType()), T.StructField("touched", T.ArrayType(T.StringType()))]


def declarations(request: dict[str, Any]) -> dict[str, Any]:
    """What a write declares, as arguments of Schema.declare."""
    from ..functions.text import TextConfig

    types, text, embed = {}, {}, {}
    for name, spec in (request.get("schema") or {}).items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        if not isinstance(spec, dict) or set(spec) - {"type", "filterable", "glob", "full_text_search", "embed"}:
            raise Invalid(f"schema of {name!r} is not understood")
        if spec.get("type"):
            types[name] = spec["type"]
        if config := TextConfig.parse(spec.get("full_text_search")):
            text[name] = config
        if spec.get("embed"):
            embed[name] = spec["embed"].get("model", "") if isinstance(spec["embed"], dict) else ""
    sharding = request.get("sharding") or {}
    return {"types": types, "text": text, "embed": embed, "metric": request.get("distance_metric"), "shards": sharding.get("num_shards")}


def names(spark: SparkSession, root: str) -> list[str]:
    """The collections under a root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in found if Collection(spark, root, n).exists())
