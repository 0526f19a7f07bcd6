"""Removal of repeated byte strings with suffix arrays by external induced sorting.

Every byte that lies in a string of WIDTH bytes which also starts earlier goes. Strings are dealt to shards so that
equal ones meet: a string's anchor is the least hash among its runs of GRAM bytes, so equal strings have equal anchors.
Consecutive strings of a document with one anchor form a segment of at most 2 * WIDTH - GRAM bytes. Anchors found in a
single place go no further, unless a string holds its anchor twice, as in a stretch that repeats a byte or a short pattern:
then equal strings may lie in that one segment. The others go into a bitmap of fixed size, so the second scan cuts
segments where the texts are and moves only those whose anchor may be elsewhere too; a false hit costs a row and
changes no result. Of equal segments only the earliest goes on, the others are covered whole; what then remains under
one anchor is sorted, shard by shard, by induced sorting (see induced.py), and strings
whose neighbours in that order have a common prefix of WIDTH bytes are repeated.

Copies of a whole text never go past the first step. Anchors with more than CROWD different segments, as under a very
frequent line, are not sorted in one shard: their strings meet by 128-bit hash, with the earliest place found by an
aggregation that is partial before the exchange.

"Earlier" orders by (doc_id, start). Defined cases: a null id comes first; a null text counts as empty and loses
nothing; texts shorter than WIDTH lose nothing; rows that repeat both the id and the text are one document read twice
and lose the same; different texts under one id come in the order of a hash; other columns are ignored; an empty table
gives no rows. Texts are read as UTF-8 bytes, whole; a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .hashing import Powers, mixed
from .induced import sorted_suffixes
from .scratch import staged

WIDTH = 100
GRAM = 32
#: Different segments under one anchor up to which they are sorted in one shard.
CROWD = 4096
#: Bytes of segments in a shard, about.
SHARD_BYTES = 4_000_000
#: Bytes of text whose anchors are found at a time.
PIECE = 500_000
#: Stretches around an anchor by which segments without a partner are known.
PARTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(127)
_POWERS = [Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)]
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes; the lowest seven bits are free."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    span = 1
    while span < gram:
        step = min(span, gram - span)
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * _SPREAD + h[step:]
        span += step
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, many: int) -> np.ndarray:
    """The least of each `many` consecutive values."""
    span = 1
    while span < many:
        step = min(span, many - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


class Cuts(NamedTuple):
    """Segments of parts that stand one after another: anchor, first string, strings, whether some string holds the anchor
    more than once (so equal strings may lie in that one segment), where the anchor begins, and the part."""

    anchors: np.ndarray
    starts: np.ndarray
    many: np.ndarray
    inner: np.ndarray
    at: np.ndarray
    part: np.ndarray


def segments(data: np.ndarray, begins: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Cuts:
    """The segments of parts of data; part i lies from begins[i] to begins[i + 1], and no string crosses parts."""
    strings = len(data) - width + 1
    if strings < 1:
        return Cuts(*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool), *(np.zeros(0, np.int64),) * 2)
    hashes = _gram_hashes(data, gram)
    # the position makes segments end where the anchor's place changes; it takes no part in the anchor
    hashes = (hashes & ~_LOW) | (np.arange(len(hashes), dtype=np.uint64) & _LOW)
    least = _least(hashes, width - gram + 1)
    # with the positions in reverse order the least lies elsewhere only where the hash is there again
    tied = ((least ^ _least(hashes ^ _LOW, width - gram + 1)) & _LOW) != _LOW
    edge = np.ones(strings, dtype=bool)
    edge[1:] = least[1:] != least[:-1]
    beyond = np.maximum(begins[1:] - width + 1, begins[:-1])  # the first start in a part that is too near its end
    for marks in (begins[:-1], beyond):
        edge[marks[marks < strings]] = True
    starts = np.flatnonzero(edge)
    many = np.diff(np.append(starts, strings))
    inner = np.logical_or.reduceat(tied, starts)
    part = np.searchsorted(begins, starts, side="right") - 1
    keep = np.flatnonzero(starts < beyond[part])
    starts = starts[keep]
    at = starts + (((least[starts] & _LOW).astype(np.int64) - starts) & 127)
    return Cuts((least[starts] & ~_LOW).view(np.int64), starts, many[keep], inner[keep], at, part[keep])


def _parts(column: pa.Array, width: int):
    """(rows, offsets in the text, bytes, begins) of texts side by side, about PIECE bytes at a time; a text longer than
    that comes in parts, which overlap by less than a string."""
    rows, offsets, held, size = [], [], [], 0
    for row, value in enumerate(column):
        data = np.frombuffer(value.as_buffer(), np.uint8)
        for at in range(0, max(1, len(data) - width + 1), PIECE):
            part = data[at : at + PIECE + width - 1]
            rows.append(row)
            offsets.append(at)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield _side_by_side(rows, offsets, held)
                rows, offsets, held, size = [], [], [], 0
    if held:
        yield _side_by_side(rows, offsets, held)


def _side_by_side(rows, offsets, held):
    return np.array(rows), np.array(offsets, dtype=np.int64), np.concatenate(held), np.cumsum([0, *map(len, held)])


def _polynomials(data: np.ndarray):
    """A function of (starts, stops) that gives two 64-bit hashes of each of these stretches of data."""
    values, sums = _BYTES[data], []
    for powers in _POWERS:
        up, down = powers(len(data))
        sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)]), down))

    def of(starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        return [mixed((total[stops] - total[starts]) * down[starts] ^ (stops - starts).astype(np.uint64)) for total, down in sums]

    return of


def _views(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint8) for v in column]


def _cut_out(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of data as a binary column."""
    ends = np.cumsum(lengths)
    index = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
    edges = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[index])])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("text"))


def _anchor_rows(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(a, th): the anchors of each text; one that a text or a string has in several places comes with two marks."""

    def run(batches):
        for batch in batches:
            ths = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, _, data, begins in _parts(batch.column(1), width):
                cut = segments(data, begins, width, gram)
                text = rows[cut.part]
                # an anchor whose place is the same goes on from one segment to the next only where its part ends
                a, own, text = (np.concatenate([x, x[cut.inner]]) for x in (cut.anchors, ths[text], text))
                order = np.lexsort((text, own, a))
                a, own, text = a[order], own[order], text[order]
                again = np.zeros(len(a), dtype=bool)
                again[1:] = (a[1:] == a[:-1]) & (own[1:] == own[:-1])
                # a copy of a text says nothing new, a repeat inside one text does
                twice = again.copy()
                twice[1:] &= text[1:] == text[:-1]
                yield _frame(("a", "th"), np.concatenate([a[~again], a[twice]]), np.concatenate([own[~again], ~own[twice]]))

    return texts.filter(F.octet_length("text") >= width).select("th", "text").mapInArrow(run, "a long, th long")


def _frame(names, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=list(names))


SEGMENT = "doc_id long, th long, start long, strings int, a long, h long, g long, inner boolean, at int, bytes binary"


def _segment_rows(texts: DataFrame, bits: np.ndarray, width: int, gram: int) -> DataFrame:
    """The segments of each text whose anchor may be in several places."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # bitmaps.BITS bits
    names = ("doc_id", "th", "start", "strings", "a", "h", "g", "inner", "at", "bytes")

    def run(batches):
        for batch in batches:
            for rows, offsets, data, begins in _parts(batch.column(2), width):
                cut = segments(data, begins, width, gram)
                chosen = bitmaps.hits(shared.value, cut.anchors.view(np.uint64), 7)
                if not len(chosen):
                    continue
                anchors, starts, many, inner, at, part = (x[chosen] for x in cut)
                h, g = (x.view(np.int64) for x in _polynomials(data)(starts, starts + many + width - 1))
                row = pa.array(rows[part])
                yield _frame(
                    names,
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    starts - begins[part] + offsets[part],
                    many.astype(np.int32),
                    anchors,
                    h,
                    g,
                    inner,
                    (at - starts).astype(np.int32),
                    _cut_out(data, starts, many + width - 1),
                )

    return texts.filter(F.octet_length("text") >= width).select("doc_id", "th", "text").mapInArrow(run, SEGMENT)


class _Shard:
    """Segments one after another on disk, each ended by a separator, as the text of one suffix array."""

    def __init__(self, folder: str, width: int, gram: int):
        self.width, self.gram, self.folder = width, gram, folder
        self.path = os.path.join(folder, "text")

    def fill(self, batches) -> None:
        held = [[] for _ in range(7)]
        for batch in batches:
            ids, views = batch.column(0), _views(batch.column(3))
            own = (ids.is_null(), ids.fill_null(0), batch.column(1), batch.column(2), batch.column(4), batch.column(5))
            for k, column in enumerate(own):
                held[k].append(column.to_numpy(zero_copy_only=False))
            held[6] += views
        lengths = np.array([len(v) for v in held[6]], dtype=np.int64)
        self.nulls, self.docs, self.marks, self.starts, inner, at = (np.concatenate(h) if h else np.zeros(0, np.int64) for h in held[:6])
        keep = self._partners(held[6], lengths, at, inner.astype(bool)) if len(lengths) else np.zeros(0, np.int64)
        for name in ("nulls", "docs", "marks", "starts"):
            setattr(self, name, getattr(self, name)[keep])
        self.lengths = lengths[keep]
        with open(self.path, "wb") as out:
            for i in keep.tolist():
                (held[6][i].astype(np.uint16) + np.uint16(2)).tofile(out)
                out.write(b"\x01\x00")
            out.write(b"\x00\x00")
        self.bases = np.concatenate([[0], np.cumsum(self.lengths + 1), [np.iinfo(np.int64).max]])

    def _partners(self, views: list[np.ndarray], lengths: np.ndarray, at: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The segments that may hold a string of another one.

        A string has from 0 to width - gram bytes before its anchor. Cut into PARTS ranges, each range has a stretch around
        the anchor that all of its strings hold, of equal strings the same one, little shorter than a string.
        """
        free = self.width - self.gram
        step = -(-(free + 1) // PARTS)
        found = [[] for _ in range(PARTS)]
        edges = np.flatnonzero(np.diff(np.cumsum(lengths) // PIECE)) + 1
        for some in np.split(np.arange(len(lengths)), edges):
            ends = np.cumsum(lengths[some])
            base = ends - lengths[some]
            hashes = _polynomials(np.concatenate([views[i] for i in some.tolist()]))
            for k in range(PARTS):
                before = min(k * step, free)
                after = max(0, free - before - step + 1)
                low, high = base + at[some] - before, base + at[some] + self.gram + after
                inside = np.flatnonzero((low >= base) & (high <= ends))
                found[k].append((some[inside], hashes(low[inside], high[inside])[0]))
        stays = inner.copy()
        for parts in found:
            who, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            stays[who] |= counts[which] > 1
        return np.flatnonzero(stays)

    def repeated(self):
        """(segment, first string, after the last string) of the runs of strings that also start earlier."""
        text = np.memmap(self.path, np.uint16, "r")
        lost, places, lcps, held = [], [], [], 0
        for some, common in sorted_suffixes(text, self.width, self.folder):
            places.append(some)
            lcps.append(common)
            held += len(some)
            if held > 500_000:
                p, c = np.concatenate(places), np.concatenate(lcps)
                edges = np.flatnonzero(c < self.width)
                cut = int(edges[-1]) if len(edges) else 0  # the last class may go on in the next block
                lost.append(self._later(p[:cut], c[:cut]))
                places, lcps, held = [p[cut:]], [c[cut:]], len(p) - cut
        if held:
            lost.append(self._later(np.concatenate(places), np.concatenate(lcps)))
        lost = np.sort(np.concatenate(lost)) if lost else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(lost) > 1])) if len(lost) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(lost)]]) - 1 if len(lost) else first
        segment = np.searchsorted(self.bases, lost[first], side="right") - 1
        return segment, lost[first] - self.bases[segment], lost[last] - self.bases[segment] + 1

    def _later(self, places: np.ndarray, lcps: np.ndarray) -> np.ndarray:
        """Of classes of equal strings, all places but those of the earliest string."""
        if not len(places):
            return places
        same = lcps >= self.width
        same[0] = False
        member = same.copy()
        member[:-1] |= same[1:]
        # a suffix that reaches its separator within WIDTH symbols is no string
        member &= self.bases[np.searchsorted(self.bases, places, side="right")] - 1 - places >= self.width
        group = np.cumsum(~same)[member]
        places = places[member]
        segment = np.searchsorted(self.bases, places, side="right") - 1
        start = self.starts[segment] + places - self.bases[segment]
        keys = (start, self.marks[segment], self.docs[segment], ~self.nulls[segment])
        order = np.lexsort((*keys, group))
        group, keys = group[order], [k[order] for k in keys]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0])) if len(group) else np.zeros(0, np.int64)
        mine = np.repeat(heads, np.diff(np.concatenate([heads, [len(group)]])))
        stays = np.ones(len(group), dtype=bool)
        for k in keys:
            stays &= k == k[mine]
        return places[order][~stays]


INTERVAL = "doc_id long, th long, s long, e long"


def _sorted_shards(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        folder = tempfile.mkdtemp()
        try:
            shard = _Shard(folder, width, gram)
            shard.fill(batches)
            if len(shard.lengths):
                segment, s, e = shard.repeated()
                docs = pa.array(shard.docs[segment], pa.int64(), mask=shard.nulls[segment].astype(bool))
                yield _frame(("doc_id", "th", "s", "e"), docs, shard.marks[segment], shard.starts[segment] + s, shard.starts[segment] + e)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return rows.select("doc_id", "th", "start", "bytes", "inner", "at").mapInArrow(run, INTERVAL)


def _hashed_strings(rows: DataFrame, width: int) -> DataFrame:
    """The strings of crowded anchors that also start earlier, met by their hash."""

    def run(batches):
        import xxhash

        for batch in batches:
            ids, marks, starts = (batch.column(i).to_pylist() for i in range(3))
            for i, value in enumerate(batch.column(3)):
                data = value.as_py()
                n = len(data) - width + 1
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[k : k + width]) for k in range(n)), "<i8").reshape(-1, 2)
                yield _frame(
                    ("doc_id", "th", "s", "h", "g"),
                    pa.array([ids[i]] * n, pa.int64()),
                    np.full(n, marks[i], np.int64),
                    np.arange(starts[i], starts[i] + n),
                    keys[:, 0].copy(),
                    keys[:, 1].copy(),
                )

    strings = rows.select("doc_id", "th", "start", "bytes").mapInArrow(run, "doc_id long, th long, s long, h long, g long")
    place = F.struct("doc_id", "th", "s")
    firsts = strings.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = staged(firsts.filter(~F.col("first").eqNullSafe(F.col("last"))).select("h", "g", "first"), "suffix-crowded")
    later = strings.join(firsts, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "th", "s", (F.col("s") + 1).alias("e"))


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, th, copy and strings (s, e): where strings that also start earlier begin, for each document that has any.

    copy marks documents whose whole text stands earlier; th is a hash of the text and tells texts under one id apart.
    """
    if not 1 <= gram <= width <= gram + 100:
        raise ValueError("gram must be between width - 100 and width")
    texts = _texts(docs, id_col, text_col)
    spark = docs.sparkSession
    anchors = _anchor_rows(texts, width, gram)
    shared = anchors.groupBy("a").agg(F.min("th").alias("low"), F.max("th").alias("high")).filter("low <> high").select("a")
    whole = staged(texts.select("doc_id", "th", "sha"), "suffix-texts")
    groups = whole.groupBy("th", "sha").agg(F.min(F.struct("doc_id")).alias("least"), F.max(F.struct("doc_id")).alias("most"))
    groups = groups.filter(~F.col("least").eqNullSafe(F.col("most"))).select("th", "sha", F.col("least.doc_id").alias("keep"))
    groups = staged(groups, "suffix-copied")
    found = staged(_segment_rows(texts, bitmaps.built(shared, "a", 7), width, gram), "suffix-segments")
    place = F.struct("doc_id", "th", "start")
    firsts = found.groupBy("h", "g").agg(F.min("a").alias("a"), F.min(place).alias("first"), F.max(place).alias("last"), F.max("inner").alias("inner"))
    firsts = staged(firsts, "suffix-firsts")
    crowds = staged(firsts.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).filter("n > 1 or inner").select("a", "n"), "suffix-crowds")
    # one join tells what is covered whole from what is to be sorted; only the latter keeps its bytes
    several = ~F.col("first").eqNullSafe(F.col("last"))
    wanted = firsts.join(crowds, "a", "left").filter(several | F.col("n").isNotNull()).select("h", "g", "first", "n")
    here = place.eqNullSafe(F.col("first"))
    joined = found.join(wanted, ["h", "g"]).withColumn("here", here).filter(~F.col("here") | F.col("n").isNotNull())
    joined = joined.select("doc_id", "th", "start", "strings", "a", "here", "n", "inner", "at", F.when(F.col("here"), F.col("bytes")).alias("bytes"))
    joined = staged(joined, "suffix-met")
    covered = joined.filter("not here").select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("strings")).alias("e"))
    met = joined.filter("here").select("doc_id", "th", "start", "bytes", "a", "n", "inner", "at")
    few = met.filter(F.col("n") <= crowd)
    size = few.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    ranged = _sorted_shards(few.repartition(max(1, size // SHARD_BYTES, spark.sparkContext.defaultParallelism), "a"), width, gram)
    crowded = _hashed_strings(met.filter(F.col("n") > crowd), width)
    lost = covered.unionByName(ranged).unionByName(crowded)
    copies = whole.join(groups, ["th", "sha"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep"))).select("doc_id", "th")
    nowhere = F.lit(None).cast("long")
    lost = lost.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "th", nowhere.alias("s"), nowhere.alias("e"), F.lit(True).alias("copy")))
    # what copies lose is known without their strings
    strings = F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "e"))).alias("strings")
    return staged(lost.groupBy("doc_id", "th").agg(strings, F.max("copy").alias("copy")), "suffix-lost")


def removed_bytes(n: int, strings, copy: bool, width: int = WIDTH) -> list[tuple[int, int]]:
    """The maximal removed runs of a text of n bytes."""
    if copy:
        return [(0, n)] if n >= width else []
    runs: list[tuple[int, int]] = []
    for s, e in sorted(strings):
        stop = e - 1 + width
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], stop))
        else:
            runs.append((s, stop))
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every document."""
    width = options.get("width", WIDTH)
    lost = repeated_strings(docs, id_col, text_col, **options)
    bits = docs.sparkSession.sparkContext.broadcast(bitmaps.built(lost, "th"))  # bitmaps.BITS bits
    lost = lost.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "strings", "copy")
    texts = _texts(docs, id_col, text_col).select("doc_id", "th", "text")
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")[: 6 if with_bytes else 5]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, data, strings, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data, runs = data.as_py(), []
                if copy is not None:
                    pairs = [] if copy else list(zip(*(strings.values.field(k).to_pylist() for k in (0, 1)), strict=True))
                    runs = removed_bytes(len(data), pairs, copy, width)
                at, kept = 0, []
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                rows.append((doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
                held += len(kept)
                if with_bytes and held > 16_000_000:
                    yield _out(names, rows)
                    rows, held = [], 0
            yield _out(names, rows)

    def chosen(batches, hit):
        for batch in batches:
            held = np.zeros(batch.num_rows, dtype=bool)
            held[bitmaps.hits(bits.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))] = True
            part = batch.filter(pa.array(held == hit))
            if part.num_rows:
                yield part

    def whole(batches):
        for batch in chosen(batches, False):
            nothing = [pa.nulls(batch.num_rows, kind) for kind in (pa.list_(pa.int64()), pa.bool_())]
            yield from run([_frame(("doc_id", "text", "strings", "copy"), batch.column(0), batch.column(2), *nothing)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    # texts that lose nothing are known by the bitmap and stay where they are
    intact = texts.mapInArrow(whole, schema)
    some = texts.mapInArrow(lambda batches: chosen(batches, True), "doc_id long, th long, text binary")
    joined = some.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    return joined.select("doc_id", "text", "strings", "copy").mapInArrow(run, schema).unionByName(intact)


def _out(names, rows) -> pa.RecordBatch:
    types = (*[pa.int64()] * 4, pa.string(), pa.binary())
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], types[i]) for i, n in enumerate(names)})


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)
