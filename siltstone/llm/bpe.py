"""Whole-text encoding with a public tokenizer, through a bounded memory of encoded pieces.

The tokenizer first splits a text by a fixed pattern and then encodes each piece on its own, so pieces seen before need
not be encoded again, and the ids of a text are the joined ids of its pieces: the same as encoding the text at once.

The pattern is applied to many texts at a time by array operations. Which of its four classes a character belongs to
(letter, number, white space, other) is asked of the tokenizer itself when a character is first seen. Pieces of up to
SHORT bytes are looked up by their bytes, exactly, in a hash table; what is not there is encoded by the tokenizers
library and remembered.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "byte_bpe_50k.json"
#: Pieces kept in memory by a worker, about 80 MB. Eviction changes speed alone.
MEMORY_PIECES = 830_000
#: Bytes of a piece that fit into its key, and of texts that are encoded at a time.
SHORT = 23
BATCH_BYTES = 1_000_000
END_ID = 0

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class _Table:
    """From the three words of a key to where its ids stand; open addressing, at most 0.4 full."""

    def __init__(self, bits: int = 16):
        self.bits, self.held = bits, 0
        self.keys = [np.zeros(1 << bits, np.uint64) for _ in range(3)]
        self.first, self.many = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _places(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, or the empty one where it would be; and which are there."""
        mixed = np.zeros(len(keys[0]), np.uint64)
        for key, by in zip(keys, _MIX, strict=True):
            mixed = (mixed ^ key) * by
            mixed ^= mixed >> np.uint64(32)
        at = (mixed & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        found = (self.keys[2][at] == keys[2]) & (self.keys[0][at] == keys[0]) & (self.keys[1][at] == keys[1])
        going = np.flatnonzero(~found & (self.keys[2][at] != 0))
        while len(going):
            at[going] = (at[going] + 1) & ((1 << self.bits) - 1)
            here = at[going]
            same = (self.keys[2][here] == keys[2][going]) & (self.keys[0][here] == keys[0][going]) & (self.keys[1][here] == keys[1][going])
            found[going[same]] = True
            going = going[~same & (self.keys[2][here] != 0)]
        return at, found

    def look_up(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, found = self._places(keys)
        return self.first[at], self.many[at], found

    def add(self, keys: list[np.ndarray], first: np.ndarray, many: np.ndarray) -> None:
        """Add keys that are not there yet, each once."""
        if self.held + len(first) > 0.4 * (1 << self.bits):
            used = np.flatnonzero(self.keys[2])
            old = [k[used] for k in self.keys], self.first[used], self.many[used]
            self.__init__(self.bits + 1)
            self.add(*old)
            return self.add(keys, first, many)
        self.held += len(first)
        left = np.arange(len(first))
        while len(left):
            at, _ = self._places([k[left] for k in keys])
            _, own = np.unique(at, return_index=True)  # of those that want one place, the first gets it
            for mine, new in zip(self.keys, keys, strict=True):
                mine[at[own]] = new[left[own]]
            self.first[at[own]], self.many[at[own]] = first[left[own]], many[left[own]]
            left = np.delete(left, own)


class PieceEncoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self._bytes[i] = len(token)  # byte-level: a character stands for a byte
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._table, self._long = _Table(), {}
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0

    def _class(self, character: str) -> int:
        cut = self._tokenizer.pre_tokenizer.pre_tokenize_str
        return next((k for k, by in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")) if len(cut(by + character + by)) == 1), SPACE)

    def _joins(self, piece: bytes) -> bool:
        """Whether a piece is a space and something else: the pattern cuts a run of such pieces where they were joined."""
        if len(piece) < 2 or piece[0] != 0x20:
            return False
        return self._classes[piece[1] if piece[1] < 0x80 else ord(piece[1:].decode("utf-8")[0])] != SPACE

    def _store(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces and keep their ids; where each stands and how many it has."""
        joins = np.fromiter(map(self._joins, pieces), dtype=bool, count=len(pieces))
        many = np.zeros(len(pieces), np.int64)
        made = []
        runs, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        if len(runs):
            own = [pieces[i] for i in runs.tolist()]
            ids = np.array(self._tokenizer.encode_batch_fast([b"".join(own).decode("utf-8")], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum([len(p) for p in own]), side="left") + 1
            many[runs] = np.diff(stops, prepend=0)
            made.append(ids)
        if len(rest):
            own = [e.ids for e in self._tokenizer.encode_batch_fast([pieces[i].decode("utf-8") for i in rest.tolist()], add_special_tokens=False)]
            many[rest] = [len(i) for i in own]
            made += [np.array(i, dtype=np.uint32) for i in own]
        total = self._used + int(many.sum())
        if total > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._used], np.zeros(2 * total - self._used, np.uint32)])
        self._ids[self._used : total] = np.concatenate(made)
        order = np.concatenate([runs, rest])
        first = np.empty(len(pieces), np.int64)
        first[order] = self._used + np.cumsum(many[order]) - many[order]
        self._used = total
        return first, many

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first byte of each piece of texts that stand one after another and begin at `starts`."""
        if len(data) and data.max() >= 0x80:
            places = np.flatnonzero((data & 0xC0) != 0x80)
            text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            begins = np.searchsorted(places, starts)
        else:
            places, text, begins = None, data, starts
        classes = self._classes[text]
        if (classes == UNKNOWN).any():
            for c in np.unique(text[classes == UNKNOWN]).tolist():
                self._classes[c] = self._class(chr(c))
            classes = self._classes[text]
        n = len(text)
        own = np.zeros(n + 1, dtype=bool)
        own[begins] = True
        edge = own.copy()
        edge[1:n] |= classes[1:] != classes[:-1]
        # white space gives its last character to what follows it, and joins it there if it is a space
        after = np.flatnonzero(edge[1:n] & (classes[:-1] == SPACE) & ~own[1:n]) + 1
        edge[after - 1] = True
        edge[after[text[after - 1] == 0x20]] = False
        # 's 't 'm 'd 're 've 'll at the start of a piece
        marks = np.flatnonzero((text[: max(0, n - 1)] == 0x27) & edge[: max(0, n - 1)] & ~own[1:n]) if n > 1 else np.zeros(0, np.int64)
        if len(marks):
            one = text[marks + 1]
            two = np.where((marks + 2 < n) & ~own[np.minimum(marks + 2, n)], text[np.minimum(marks + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            edge[marks[short | long] + 1] = False
            edge[marks[short] + 2] = True
            edge[marks[long & ~short] + 3] = True
        found = np.flatnonzero(edge[:n])
        return found if places is None else places[found]

    def _known(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece stand, and how many it has."""
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        at = np.zeros(len(first), np.int64)
        many = np.zeros(len(first), np.int64)
        short = np.flatnonzero(size <= SHORT)
        begin, length = first[short], size[short]
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        keys = [eights[begin + 8 * k] & _MASKS[np.clip(length - 8 * k, 0, 8)] for k in range(3)]
        keys[2] |= length.astype(np.uint64) << np.uint64(56)  # no key is zero
        at[short], many[short], found = self._table.look_up(keys)
        new = np.flatnonzero(~found)
        if len(new):
            rows = np.stack([k[new] for k in keys], axis=1)
            _, some, which = np.unique(np.ascontiguousarray(rows).view("V24").ravel(), return_index=True, return_inverse=True)
            mine = new[some]
            own_at, own_many = self._store([data[a : a + n].tobytes() for a, n in zip(begin[mine].tolist(), length[mine].tolist(), strict=True)])
            self._table.add([k[mine] for k in keys], own_at, own_many)
            at[short[new]], many[short[new]] = own_at[which], own_many[which]
        rest = np.flatnonzero(size > SHORT)
        if len(rest):
            names = [data[a : a + n].tobytes() for a, n in zip(first[rest].tolist(), size[rest].tolist(), strict=True)]
            fresh = list({p for p in names if p not in self._long})
            if fresh:
                self._long.update((p, (int(a), int(m))) for p, a, m in zip(fresh, *self._store(fresh), strict=True))
            at[rest], many[rest] = np.array([self._long[p] for p in names], dtype=np.int64).T
        return at, many

    def _joined(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand one after another, and how many each has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        if self._table.held + len(self._long) > MEMORY_PIECES or self._used > 8 * MEMORY_PIECES:
            self._forget()
        first = self._pieces(data, starts)
        size = np.diff(np.append(first, len(data)))
        at, many = self._known(data, first, size)
        ends = np.cumsum(many)
        ids = self._ids[np.repeat(at - ends + many, many) + np.arange(ends[-1])]
        before = np.append(0, ends)[np.searchsorted(first, np.append(starts, len(data)))]
        return ids, np.diff(before)

    def column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each text) of a string array, about BATCH_BYTES of text at a time; a null is an empty text.

        Special tokens in a text are treated as the tokenizer treats them.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BATCH_BYTES, side="right")) - 1)
            part = data[edges[low] : edges[high]]
            if any(s in part.tobytes() for s in self._special):
                own = [self._tokenizer.encode(t.as_py().decode("utf-8"), add_special_tokens=False).ids for t in texts[low:high]]
                yield np.concatenate([np.array(i, dtype=np.uint32) for i in own]), np.array([len(i) for i in own], dtype=np.int64)
            else:
                yield self._joined(part, edges[low:high] - edges[low])
            low = high

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        out = []
        for ids, many in self.column(pa.array(texts, pa.string())):
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(many)).tolist()
            out += [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def encoded(batches, path: str) -> Iterator[tuple[int | None, bytes]]:
    """(id, packed ids with the end id) for Arrow batches of an id and a text."""
    end = END_ID.to_bytes(4, "little")
    for batch in batches:
        names = iter(batch.column(0).to_pylist())
        for ids, many in encoder(path).column(batch.column(1)):
            packed, at = ids.astype("<u4").tobytes(), 0
            for n in (4 * many).tolist():
                yield next(names), packed[at : at + n] + end
                at += n
