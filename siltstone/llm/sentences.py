"""Substring deduplication with sliding sentence spans.

A text is cut into sentences: after a word that ends in one of . ! ? and at line ends. Passages that repeat often begin
and end inside sentences, so sentences are cut further where only their own words decide: before each word whose value
is the least in some CUT consecutive words of the sentence. Every run of consecutive pieces, from each piece on until it
holds RUN words or more, is hashed to 128 bits. The occurrence with the smallest (id, position) of a hash is the first;
every piece that any other occurrence covers is removed.

Equal words are cut alike but for CUT - 1 words at either end, so of two equal passages of 4 * CUT - 3 + RUN words
(51), wherever they begin, some run is hashed in both. What lies outside whole runs at the two ends of a repeated
passage stays, 2 * CUT words or so. Shorter repeats, such as a line that many documents share, stay as they are.

Runs are not all exchanged. A run's anchor is the least hash among the GRAM words long grams of its first RUN words, so
equal runs have equal anchors, and neighbouring runs mostly share one. A first exchange holds anchors with a mark of
their text, pre-aggregated; those met in one place alone go no further. The others go into a bitmap of fixed size, so
that the second scan sends on only runs whose anchor is in several places; a false hit costs one row and changes no
result. Runs that repeat are joined back with the first occurrence, which comes from an aggregation that is partial
before the exchange, so a passage in a third of all documents is never gathered. Texts equal as a whole are known by
their hash: only the first counts as an occurrence.

Words are cut at ASCII white space and compared byte for byte, white space between them does not matter. Whole texts
are read.

Defined cases: a null text counts as empty and has no pieces; texts with fewer than RUN words lose nothing; a run that
repeats within one text loses its later occurrences; rows that repeat both the id and the text are one document read
twice and keep or lose the same; a null id comes first; different texts under one id come in the order of a hash; the
white space after a removed piece goes with it, that before the first word stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .hashing import Powers, mixed
from .scratch import staged

#: Consecutive words of a sentence of which the least valued begins a piece; the least number of words in a run; and the
#: words of a gram.
CUT, RUN, GRAM = 5, 34, 16
#: Characters of text that are laid out at a time.
GROUP_CHARS = 1_000_000
#: The places of a copied text stand as all of its runs.
_ALL = -1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
# Weights of the characters of a word in its value.
VALUE_FIRST, VALUE_SECOND, VALUE_LAST, VALUE_BEFORE_LAST, VALUE_LENGTH = 131071, 8191, 524287, 127, 65537
VALUE_FACTOR, VALUE_PRIME = 48271, 2147483647


_powers = [Powers(int(m)) for m in _MIX[:2]]
_coefficients = np.zeros(0, np.uint64)


def _letters(n: int) -> np.ndarray:
    global _coefficients
    if len(_coefficients) < n:
        _coefficients = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)
    return _coefficients


def _windowed(values: np.ndarray, many: int, least) -> np.ndarray:
    span = 1
    while span < many:
        step = min(span, many - span)
        values = least(values[:-step], values[step:])
        span += step
    return values


@dataclass
class Layout:
    """Texts one after another: words, pieces and runs. Words are numbered throughout, characters by code point."""

    begins: np.ndarray  # the first character of each text, and the end
    words: np.ndarray  # the first character of each word
    firsts: np.ndarray  # the first word of each text, and the end
    pieces: np.ndarray  # the first word of each piece, and the end
    runs: np.ndarray  # the first word of each run
    stops: np.ndarray  # the word after each run
    own: np.ndarray  # each word as a number

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, words, side="right") - 1

    def hashes(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit halves of the hash of the chosen runs."""
        runs, stops, halves = self.runs[chosen], self.stops[chosen], []
        for powers in _powers:
            up, down = powers(len(self.own))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.own * up, dtype=np.uint64)])
            halves.append(mixed((sums[stops] - sums[runs]) * down[runs] ^ (stops - runs).astype(np.uint64)).view(np.int64))
        return halves

    def anchors(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor of each run; and the places of all anchors (words) with their hashes."""
        gram = min(GRAM, run)
        if not len(self.runs):
            return np.zeros(0, np.uint64), self.runs, np.zeros(0, np.uint64)
        grams, span = self.own, 1
        while span < gram:
            step = min(span, gram - span)
            grams = mixed(grams[:-step] * _MIX[0] + grams[step:] * _MIX[3])
            span += step
        many = run - gram + 1
        least = _windowed(grams, many, np.minimum)
        of_runs = least[self.runs]
        only = np.zeros(len(least), np.uint64)
        only[self.runs] = of_runs
        pad = np.zeros(many - 1, np.uint64)
        places = np.flatnonzero(_windowed(np.concatenate([pad, only, pad]), many, np.maximum) == grams)
        return of_runs, places, grams[places]


def laid_out(texts: list[str], cut: int = CUT, run: int = RUN) -> Layout:
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    n = len(chars)
    space = (chars == 0x20) | (chars - np.uint32(9) <= 4)
    edge = np.zeros(n + 1, dtype=bool)  # a text begins
    edge[begins] = True
    starts = np.flatnonzero(~space & (edge[:n] | np.concatenate([[True], space[:-1]]))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1 if n else starts
    many = len(starts)
    firsts = np.searchsorted(starts, begins)
    if not many:
        return Layout(begins, starts, firsts, np.zeros(1, np.int64), starts, starts, np.zeros(0, np.uint64))
    lengths = ends - starts
    # words as 64-bit numbers
    at = np.flatnonzero(~space)
    offset = at - np.repeat(starts, lengths)
    own = np.add.reduceat((chars[at].astype(np.uint64) + np.uint64(1)) * _letters(int(lengths.max()))[offset], np.cumsum(lengths) - lengths)
    own = mixed(own ^ lengths.astype(np.uint64) * _MIX[3])
    ascending = [chars[i].astype(np.int64) for i in (starts, np.minimum(starts + 1, ends - 1), ends - 1, np.maximum(ends - 2, starts))]
    value = sum(c * k for c, k in zip(ascending, (VALUE_FIRST, VALUE_SECOND, VALUE_LAST, VALUE_BEFORE_LAST), strict=True))
    value = (value + lengths * VALUE_LENGTH) * VALUE_FACTOR % VALUE_PRIME
    # where sentences begin
    last = chars[ends - 1]
    lines = np.concatenate([[0], np.cumsum(chars == 10)])
    closes = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    closes[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    begin = np.zeros(many + 1, dtype=bool)
    begin[firsts] = True
    begin[1:] |= closes
    sentence = np.cumsum(begin[:many])
    if many >= cut:
        least = np.where(sentence[: many - cut + 1] == sentence[cut - 1 :], _windowed(value, cut, np.minimum), -1)
        pad = np.full(cut - 1, -1, np.int64)
        begin[:many] |= _windowed(np.concatenate([pad, least, pad]), cut, np.maximum) == value
    begin[many] = True
    pieces = np.flatnonzero(begin)
    # runs end with their text at the latest
    after = np.repeat(firsts[1:], np.diff(firsts))
    runs = pieces[:-1]
    runs = runs[runs + run <= after[runs]]
    stops = pieces[np.searchsorted(pieces, runs + run)]
    return Layout(begins, starts, firsts, pieces, runs, stops, own)


def _groups(texts: pa.Array):
    """(first row, texts) of about GROUP_CHARS characters each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + GROUP_CHARS, side="right")))
        yield low, [t or "" for t in texts[low:high].to_pylist()]
        low = high


def _frame(names, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=list(names))


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), F.xxhash64(F.lit(1), text).alias("same"), F.col(text_col).alias("text"))


def _marks(texts: DataFrame, cut: int, run: int) -> DataFrame:
    """(h, own): the anchors of each text; one that a text has in several places comes with two marks."""

    def found(batches):
        for batch in batches:
            owns = batch.column(0).to_numpy(zero_copy_only=False)
            for low, texts in _groups(batch.column(1)):
                lay = laid_out(texts, cut, run)
                _, places, h = lay.anchors(run)
                text, h = lay.text_of(places), h.view(np.int64)
                own = owns[low + text]
                order = np.lexsort((text, own, h))
                h, own, text = h[order], own[order], text[order]
                again = np.zeros(len(h), dtype=bool)
                again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
                # a copy of a text says nothing new, a repeat inside one text does
                inner = again.copy()
                inner[1:] &= text[1:] == text[:-1]
                yield _frame(("h", "own"), np.concatenate([h[~again], h[inner]]), np.concatenate([own[~again], ~own[inner]]))

    return texts.select("own", "text").mapInArrow(found, "h long, own long")


def _runs(texts: DataFrame, bits: np.ndarray, cut: int, run: int) -> DataFrame:
    """doc_id, own, pos (word) and hash (h, g) of the runs whose anchor may be in several places."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # bitmaps.BITS bits

    def found(batches):
        known = shared.value
        for batch in batches:
            for low, texts in _groups(batch.column(2)):
                lay = laid_out(texts, cut, run)
                keep = bitmaps.hits(known, lay.anchors(run)[0])
                if len(keep):
                    text = lay.text_of(lay.runs[keep])
                    rows = pa.array(text + low)
                    pos = (lay.runs[keep] - lay.firsts[text]).astype(np.int32)
                    yield _frame(("doc_id", "own", "pos", "h", "g"), batch.column(0).take(rows), batch.column(1).take(rows), pos, *lay.hashes(keep))

    return texts.select("doc_id", "own", "text").mapInArrow(found, "doc_id long, own long, pos int, h long, g long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, run: int = RUN) -> DataFrame:
    """doc_id, own and starts (words), in each document that has any: where runs that are not the first begin.

    A text that stands whole in an earlier document has _ALL among its starts.
    """
    texts = _chosen(docs, id_col, text_col)
    shared = _marks(texts, cut, run).groupBy("h").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("h")
    found = staged(_runs(texts, bitmaps.built(shared, "h"), cut, run), "sentence-runs")
    place = F.struct("doc_id", "own", "pos")
    firsts = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written, so that both sides of the join are dealt anew and a hot run can be split
    firsts = staged(firsts.filter(~F.col("first").eqNullSafe(F.col("last"))).select("h", "g", "first"), "sentence-firsts")
    later = found.join(firsts, ["h", "g"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "own", "pos")
    whole = staged(texts.select("doc_id", "own", "same"), "sentence-texts")
    groups = whole.groupBy("own", "same").agg(F.min(F.struct("doc_id")).alias("least"), F.max(F.struct("doc_id")).alias("most"))
    groups = groups.filter(~F.col("least").eqNullSafe(F.col("most"))).select("own", "same", F.col("least.doc_id").alias("keep"))
    groups = staged(groups, "sentence-copied")
    copies = whole.join(groups, ["own", "same"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    lost = later.unionByName(copies.select("doc_id", "own", F.lit(_ALL).alias("pos")))
    return staged(lost.groupBy("doc_id", "own").agg(F.collect_set("pos").alias("starts")), "sentence-starts")


def removed_pieces(lay: Layout, i: int, starts: np.ndarray | None) -> np.ndarray:
    """Which pieces of the i-th text go, if runs at `starts` (words of the text) do."""
    low, high = np.searchsorted(lay.pieces, lay.firsts[i : i + 2])
    change = np.zeros(high - low + 1, dtype=np.int64)
    if starts is not None and len(starts) and high > low:
        a, b = np.searchsorted(lay.runs, lay.firsts[i : i + 2])
        own = np.arange(a, b) if (starts == _ALL).any() else np.searchsorted(lay.runs, starts + lay.firsts[i])
        np.add.at(change, np.searchsorted(lay.pieces, lay.runs[own]) - low, 1)
        np.add.at(change, np.searchsorted(lay.pieces, lay.stops[own]) - low, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, run: int = RUN) -> DataFrame:
    """doc_id, text (what is kept), n_sentences (pieces), n_removed (of these) and removed (start:end in code points,
    comma-joined)."""
    found = repeated(docs, id_col, text_col, cut, run).select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"), "starts")
    texts = _chosen(docs, id_col, text_col)
    joined = texts.join(found, texts.doc_id.eqNullSafe(found["__id"]) & (texts.own == found["__own"]), "left")
    names = ("doc_id", "text", "n_sentences", "n_removed", "removed")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def removed(batches):
        for batch in batches:
            ids, lost, null = batch.column(0), batch.column(2), batch.column(1).is_null().to_pylist()
            for low, group in _groups(batch.column(1)):
                lay, rows = laid_out(group, cut, run), []
                for i, text in enumerate(group):
                    starts = lost[low + i].values
                    gone = removed_pieces(lay, i, None if starts is None else starts.to_numpy(zero_copy_only=False).astype(np.int64))
                    spans = ""
                    if gone.any():
                        first = np.searchsorted(lay.pieces, lay.firsts[i])
                        marks = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        edges = np.append(lay.words[lay.pieces[first : first + len(gone)]] - lay.begins[i], len(text))
                        pairs = edges[marks].reshape(-1, 2).tolist()
                        at, kept = 0, []
                        for a, b in pairs:
                            kept.append(text[at:a])
                            at = b
                        text = "".join([*kept, text[at:]])
                        spans = ",".join(f"{a}:{b}" for a, b in pairs)
                    rows.append((ids[low + i].as_py(), None if null[low + i] else text, len(gone), int(gone.sum()), spans))
                yield _frame(names, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)])

    return joined.select("doc_id", "text", "starts").mapInArrow(removed, "doc_id long, text string, n_sentences long, n_removed long, removed string")


def op4_sentence_spans(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_sentences", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_VALUE = (
    f"(unicode(k[1]) * {VALUE_FIRST}::BIGINT + unicode(k[least(2, length(k))]) * {VALUE_SECOND}::BIGINT + unicode(k[length(k)]) * {VALUE_LAST}::BIGINT"
    f" + unicode(k[greatest(length(k) - 1, 1)]) * {VALUE_BEFORE_LAST}::BIGINT + length(k) * {VALUE_LENGTH}::BIGINT) * {VALUE_FACTOR} % {VALUE_PRIME}"
)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS raws FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, n, raw, regexp_replace(raw, '[\x20\x09-\x0D]+$', '') AS k
      FROM (SELECT doc_id, i, len(raws) AS n, raws[i] AS raw FROM (SELECT doc_id, raws, unnest(range(1, len(raws) + 1)) AS i FROM t))),
v AS (SELECT *, {_VALUE} AS v,
             coalesce(lag(regexp_matches(k, '[.!?]$') OR contains(raw, chr(10))) OVER (PARTITION BY doc_id ORDER BY i), true) AS opens FROM w),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sentence FROM v),
m AS (SELECT *, CASE WHEN count(*) OVER ahead = {CUT} THEN min(v) OVER ahead ELSE -1 END AS least FROM s
      WINDOW ahead AS (PARTITION BY doc_id, sentence ORDER BY i ROWS BETWEEN CURRENT ROW AND {CUT - 1} FOLLOWING)),
b AS MATERIALIZED (SELECT *, opens OR v = max(least) OVER (PARTITION BY doc_id, sentence ORDER BY i ROWS BETWEEN {CUT - 1} PRECEDING AND CURRENT ROW) AS cut FROM m),
p AS MATERIALIZED (SELECT doc_id, i, n FROM b WHERE cut),
e AS (SELECT doc_id, i FROM p UNION SELECT DISTINCT doc_id, n + 1 FROM p),
r AS (SELECT p.doc_id, p.i, e.i AS stop FROM (SELECT doc_id, i, i + {RUN} AS want FROM p WHERE i + {RUN} <= n + 1) p
      ASOF JOIN e ON p.doc_id = e.doc_id AND e.i >= p.want),
l AS (SELECT doc_id, list(k ORDER BY i) AS ks FROM b GROUP BY doc_id),
h AS (SELECT r.doc_id, r.i, r.stop, array_to_string(ks[r.i : r.stop - 1], ' ') AS run FROM r JOIN l USING (doc_id)),
g AS MATERIALIZED (SELECT doc_id, i, stop FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM h) WHERE nth > 1),
d AS (SELECT doc_id, i, sum(x) AS x FROM (SELECT doc_id, i, 1 AS x FROM g UNION ALL SELECT doc_id, stop, -1 FROM g) GROUP BY doc_id, i),
f AS MATERIALIZED (SELECT b.doc_id, b.i, raw, cut, sum(coalesce(x, 0)) OVER (PARTITION BY b.doc_id ORDER BY b.i) > 0 AS gone,
             sum(length(raw)) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS stop
      FROM b LEFT JOIN d ON b.doc_id = d.doc_id AND b.i = d.i),
y AS (SELECT doc_id, a0, string_agg((a0 + a) || ':' || (a0 + z), ',' ORDER BY a) AS removed FROM (
        SELECT doc_id, part, min(stop - length(raw))::BIGINT AS a, max(stop)::BIGINT AS z FROM (
          SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part FROM f WHERE gone) GROUP BY doc_id, part)
      JOIN (SELECT doc_id, length(regexp_extract(text, '^[\x20\x09-\x0D]*')) AS a0 FROM t) USING (doc_id) GROUP BY doc_id, a0),
z AS (SELECT doc_id, count(*) FILTER (cut) AS n_sentences, count(*) FILTER (cut AND gone) AS n_removed,
             coalesce(string_agg(raw, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       sha256(regexp_extract(t.text, '^[\x20\x09-\x0D]*') || coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN z USING (doc_id) LEFT JOIN y USING (doc_id)
"""
