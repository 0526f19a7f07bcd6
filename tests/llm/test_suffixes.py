import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from siltstone.llm import suffixes
from siltstone.llm.induced import sorted_suffixes


def brute(rows, width):
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        data = (rows[i][1] or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - width + 1):
            key = data[s : s + width]
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[rows[i][0]] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("letters,memory", [(1, 50), (2, 7), (3, 10**6), (40, 30)])
def test_order_and_common_prefixes(letters, memory):
    r = random.Random(letters)
    for _ in range(60):
        s = [r.randrange(1, letters + 1) for _ in range(r.randrange(1, 90))]
        s += s[: r.randrange(len(s))] + s
        text = np.array([*s, 0], dtype=np.uint16)
        out = [(p, c) for ps, cs in sorted_suffixes(text, 10_000, memory=memory) for p, c in zip(ps.tolist(), cs.tolist(), strict=True)]
        s.append(0)
        assert [p for p, _ in out] == sorted(range(len(s) - 1), key=lambda i: s[i:], reverse=True)
        for (p, _), (q, c) in zip(out, out[1:], strict=False):
            assert s[p : p + c] == s[q : q + c] and s[p + c] != s[q + c]


def mixture(seed, documents):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghéü") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    passages = [" ".join(r.choice(words) for _ in range(r.randrange(5, 60))) for _ in range(6)]
    texts = ["", None, "x" * 700, "ab" * 400, "x" * 99]
    for _ in range(documents):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(3), r.choice(passages))
        texts.append("\n".join(parts))
        if r.random() < 0.3:
            texts += [texts[-1]] * r.randrange(1, 4)
        if r.random() < 0.3:
            own = texts[-1].split(" ")
            own[r.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    r.shuffle(texts)
    return list(zip(r.sample(range(-1000, 9000), len(texts)), texts, strict=True))


@pytest.mark.parametrize("crowd", [256, 2])
def test_equals_brute_force(spark, crowd):
    rows = mixture(crowd, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove_repeats(frame, crowd=crowd).collect()}
    assert got == brute(rows, 100)


def test_equal_strings_in_one_segment_are_marked():
    r = random.Random(4)
    for n in range(101, 169):
        for offset in range(128):
            data = np.frombuffer(r.randbytes(128 + offset) + b"=" * n + r.randbytes(150), np.uint8)
            _, starts, many, inner, _, _ = suffixes.segments(data, np.array([0, len(data)]))
            at = np.repeat(np.arange(len(starts)), many)[128 + offset : 128 + offset + n - 99]
            assert inner[at[:-1][at[:-1] == at[1:]]].all() and (at[0] != at[-1] or inner[at[0]])


def test_repeated_patterns_equal_brute_force(spark):
    """Each text repeats a pattern of its own, at every offset mod 128, and some texts have the stretch of another."""
    r = random.Random(6)

    def noise(n):
        return "".join(chr(r.randrange(48, 123)) for _ in range(n))

    patterns = ["".join(p) for p in combinations("abcdefghijklmnop", 3)]
    r.shuffle(patterns)
    rows = [(i, noise(128 + i % 128) + patterns[i] * (34 + i // 128 * 5) + noise(120)) for i in range(500)]
    rows += [(1000 + i, noise(120) + rows[i][1][60:-60] + noise(9)) for i in range(0, 500, 7)]
    rows += [(2000, noise(128) + "=" * 130 + noise(120))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove_repeats(frame).collect()}
    assert got == brute(rows, 100)


def test_edge_rows(spark):
    long = " ".join(str(i) for i in range(400))
    rows = [(1, long, "z"), (1, long, "z"), (None, "q" + long[500:900], "z"), (2, None, "z"), (3, "", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, copy string")
    out = suffixes.remove_repeats(frame).collect()
    assert len(out) == 5
    assert [x.n_removed for x in out if x.doc_id is None] == [0]
    assert [(x.n_removed, x.n_spans) for x in out if x.doc_id == 1] == [(400, 1)] * 2
    assert suffixes.remove_repeats(frame.filter("false")).count() == 0


def test_pieces_of_a_long_text_agree(monkeypatch):
    import pyarrow as pa

    data = random.Random(1).randbytes(5000) * 2
    column = pa.array([b"short", data, b"", data[:100]], pa.binary())

    def strings():
        found = []
        for rows, offsets, side, begins in suffixes._parts(column, 100):
            cut = suffixes.segments(side, begins)
            for a, s, n, p in zip(cut.anchors, cut.starts, cut.many, cut.part, strict=True):
                found += [(rows[p], s - begins[p] + offsets[p] + k, a) for k in range(n)]
        return sorted(found)

    whole = strings()
    assert [(r, s) for r, s, _ in whole] == [(1, s) for s in range(9901)] + [(3, 0)]
    monkeypatch.setattr(suffixes, "PIECE", 1500)
    assert strings() == whole
