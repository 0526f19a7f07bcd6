"""From text to tokens, as columns.

Split at everything that is not alphabetic or numeric, lower-case, drop stopwords, stem, fold accents, drop tokens
that are too long. All but stemming and folding are built-in functions; these two see each distinct token of an Arrow
batch once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from . import stemmers

# The words that are never searched for.
ENGLISH_STOPWORDS = """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to
was will with
""".split()
INDONESIAN_STOPWORDS = """
acap ada adalah adapun agar akan akibat aku amat anda antara apa apabila apakah atas atau bagaimana bagi bahkan bahwa
banyak bawah beberapa begitu belum berapa berupa biasa bila bisa boleh buat bukan cukup dahulu dalam dan dapat dari
daripada demi demikian dengan depan di dia dini dll dsb dulu empat guna hal hampir hanya harus hingga ia ialah ini itu
jadi jika juga kalau kali kami kamu kan karena kata ke kecuali kemudian kepada ketika kini kita lagi lain lalu lama
lebih maka makin mana masih maupun melalui memang mengapa mereka merupakan meski mungkin namun nanti nya oleh pada
padahal paling para pula pun saat saja sama sambil sampai sangat saya sebab sebagai sebelum sedang segera sehingga
sejak sekali sekarang selain selalu selama seluruh sementara semua sendiri seorang sepanjang seperti serta setelah
setiap siapa sini situ suatu sudah supaya tanpa tapi telah tentang terhadap termasuk tersebut tetapi tidak tuju untuk
usai walau walaupun yaitu yakni yang
""".split()
STOPWORDS = {"english": ENGLISH_STOPWORDS, "indonesian": INDONESIAN_STOPWORDS}
#: Tokens that are stemmed, or whose positions are sorted, together, and one list more; and stems remembered at most.
TOKENS_AT_ONCE, STEMS_KNOWN = 250_000, 200_000
POSITIONS = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))
SEPARATOR = "[^\\p{IsAlphabetic}\\p{N}]+"


@dataclass(frozen=True)
class TextConfig:
    language: str = "english"
    stemming: bool = True
    remove_stopwords: bool = True
    ascii_folding: bool = False
    case_sensitive: bool = False
    max_token_length: int = 39
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if self.language not in stemmers.LANGUAGES:
            raise Invalid(f"unknown language {self.language!r}")

    @classmethod
    def parse(cls, raw) -> TextConfig | None:
        """true for the defaults, or an object with a tokenizer object and k1 and b."""
        if raw is False or raw is None:
            return None
        if raw is True:
            return cls()
        try:
            return cls(**(raw.get("tokenizer") or {}) | {k: v for k, v in raw.items() if k != "tokenizer"})
        except (TypeError, AttributeError) as e:
            raise Invalid(f"full_text_search: {e}") from e

    def to_json(self) -> dict:
        return asdict(self)


def fold(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))


def _stemmed(batches: Iterator[pa.Array], config: TextConfig) -> Iterator[pa.Array]:
    """Token lists stemmed and folded, in parts. Each distinct token of a part is looked at once; the memory of tokens
    lives as long as the worker's task."""
    known: dict[str, str] = {}
    stem = stemmers.stemmer(config.language) if config.stemming else str

    def one(token: str) -> str:
        found = known.get(token)
        if found is None:
            found = stem(token)
            if config.ascii_folding:
                found = fold(found)
            if len(known) > STEMS_KNOWN:
                known.clear()
            known[token] = found
        return found

    for batch in batches:
        for lists, lengths in _parts(batch):
            coded = lists.flatten().dictionary_encode()
            ends = pa.array([one(t) for t in coded.dictionary.to_pylist()], pa.string())
            edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(edges), ends.take(coded.indices), mask=lists.is_null())


def _finished(config: TextConfig):
    """A function of token lists that stems and folds."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _stemmed(batches, config)

    return run


def _finished_positions(config: TextConfig):
    """A function of token lists that stems and folds, drops what is too long and finds positions: one pass through
    Python, one worker a task."""

    @F.arrow_udf(TERMS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in _stemmed(batches, config):
            ends, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            octets = pc.binary_length(ends).to_numpy(zero_copy_only=False)
            kept = (octets > 0) & (octets <= config.max_token_length)
            lengths = np.bincount(np.repeat(np.arange(len(lists)), sizes)[kept], minlength=len(lists))
            edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield _positions(pa.ListArray.from_arrays(pa.array(edges), ends.filter(pa.array(kept))), lengths)

    return run


def tokens(text: Column, config: TextConfig | None = None) -> Column:
    """The tokens of a text column, in order and with repeats; null for null."""
    config = config or TextConfig()
    found = _words(text, config)
    if config.stemming or config.ascii_folding:
        found = _finished(config)(found)
    return _short(found, config)


def term_positions(text: Column, config: TextConfig) -> Column:
    """Each distinct token of a text column and where it stands among the tokens, from 0."""
    found = _words(text, config)
    return _finished_positions(config)(found) if config.stemming or config.ascii_folding else positions(_short(found, config))


def _words(text: Column, config: TextConfig) -> Column:
    found = F.split(text if config.case_sensitive else F.lower(text), SEPARATOR)
    stop = STOPWORDS.get(config.language, []) if config.remove_stopwords else []
    return F.filter(found, lambda t: (t != "") & (~t.isin(*stop) if stop else F.lit(True)))


def _short(found: Column, config: TextConfig) -> Column:
    return F.filter(found, lambda t: (F.octet_length(t) > 0) & (F.octet_length(t) <= config.max_token_length))


@F.arrow_udf(TERMS)
def positions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of a token list, each distinct token and where it stands, from 0."""
    for batch in batches:
        found = [_positions(lists, lengths) for lists, lengths in _parts(batch)]
        yield pa.concat_arrays(found) if found else pa.array([], POSITIONS)


def _parts(batch: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Whole lists of a batch with their lengths, about TOKENS_AT_ONCE tokens at a time. Stems of a part go
    back before the next is looked at, so their memory follows the part and not the batch."""
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // TOKENS_AT_ONCE
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a), lengths[a:b]


def _positions(lists: pa.Array, lengths: np.ndarray) -> pa.Array:
    coded = lists.flatten().dictionary_encode()
    n, row = len(coded), np.repeat(np.arange(len(lists), dtype=np.int64), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    where = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), pa.array(place[order], pa.int32()))
    terms = coded.dictionary.take(coded.indices.take(pa.array(order[first])))
    found = pa.StructArray.from_arrays([terms, where], ["term", "positions"])
    edges = np.append(0, np.cumsum(np.bincount(row[order[first]], minlength=len(lists))))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found)


def joined(column: Column, kind: str) -> Column:
    """Text of an attribute: a string, or a list of strings joined by spaces."""
    return F.array_join(column, " ") if kind == "[]string" else column


def tokenize(text: str, config: TextConfig | None = None) -> list[str]:
    """The same for one string, as queries need it."""
    config = config or TextConfig()
    runs, now = [], []
    for c in text if config.case_sensitive else text.lower():
        if c.isalpha() or unicodedata.category(c)[0] == "N":
            now.append(c)
        elif now:
            runs.append("".join(now))
            now = []
    if now:
        runs.append("".join(now))
    stop = set(STOPWORDS.get(config.language, [])) if config.remove_stopwords else set()
    stem = stemmers.stemmer(config.language) if config.stemming else str
    out = []
    for token in runs:
        if token not in stop:
            token = stem(token)
            token = fold(token) if config.ascii_folding else token
            if 0 < len(token.encode()) <= config.max_token_length:
                out.append(token)
    return out
