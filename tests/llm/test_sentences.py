"""Sentence spans against a plain version, on repeats that begin anywhere and on edge rows."""

import random
import re
from collections import Counter

from siltstone.llm import bitmaps
from siltstone.llm import sentences as S


def plain_pieces(text):
    """(words with the white space after them, first words of pieces)"""
    raws = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    words = [re.sub(r"[\x20\x09-\x0D]+$", "", r) for r in raws]

    def value(w):
        c = [ord(w[0]), ord(w[min(1, len(w) - 1)]), ord(w[-1]), ord(w[max(0, len(w) - 2)]), len(w)]
        weights = (S.VALUE_FIRST, S.VALUE_SECOND, S.VALUE_LAST, S.VALUE_BEFORE_LAST, S.VALUE_LENGTH)
        return sum(a * b for a, b in zip(c, weights, strict=True)) * S.VALUE_FACTOR % S.VALUE_PRIME

    begins = {0} | {i + 1 for i, (w, r) in enumerate(zip(words, raws, strict=True)) if w[-1] in ".!?" or "\n" in r}
    values, cuts = [value(w) for w in words], set()
    for i in range(len(words) - S.CUT + 1):
        if not begins & set(range(i + 1, i + S.CUT)):
            least = min(values[i : i + S.CUT])
            cuts |= {i + k for k in range(S.CUT) if values[i + k] == least}
    return raws, words, sorted((begins | cuts) & set(range(len(words))))


def brute_force(rows):
    """rows: (id, order, text). What is kept of each."""
    seen, kept = set(), []
    for _, _, text in sorted(set(rows), key=lambda r: r[:2]):
        raws, words, starts = plain_pieces(text or "")
        edges, gone = [*starts, len(words)], set()
        for p in starts:
            if p + S.RUN <= len(words):
                q = next(e for e in edges if e >= p + S.RUN)
                run = tuple(words[p:q])
                if run in seen:
                    gone |= set(range(p, q))
                seen.add(run)
        lead = re.match(r"[\x20\x09-\x0D]*", text or "")[0]
        kept.append(lead + "".join(r for i, r in enumerate(raws) if i not in gone))
    return kept


def prose(r, n, marks=0.1):
    return " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) + ("." if r.random() < marks else "") for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(11)
    passages = [prose(r, 51, m) for m in (0.0, 0.05, 0.3)] + [prose(r, 60, 0.1).replace(" ", "\n", 2)]
    texts = [prose(r, r.randint(0, 40)) + " " + p + " " + prose(r, r.randint(0, 40)) for p in passages for _ in range(6)]
    texts += ["", None, " \n\t ", "x " * 300, "Ha! " * 120, "  " + texts[2], texts[3], texts[3], " ".join([prose(r, 70)] * 3), prose(r, 20000)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, prose(r, 80)), (None, texts[7]), (None, prose(r, 90))]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, starts string, own int").repartition(5)
    order = {(x[0], x[1]): (x[0] is not None, x[0] or 0, x[2]) for x in frame.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()}
    want = Counter(brute_force([(order[row][:2], order[row][2], row[1]) for row in set(rows)]))
    got = {(x.doc_id, x.text, x.removed) for x in S.remove_repeats(frame).collect()}
    assert Counter(t or "" for _, t, _ in got) == want
    assert S.remove_repeats(frame).count() == len(rows)


def test_passages_of_51_words_are_caught_and_short_ones_stay(spark):
    r = random.Random(3)
    for marks in (0.0, 0.1, 0.5):
        passage, line = prose(r, 51, marks), prose(r, S.RUN - 1, marks)
        rows = [(i, f"{prose(r, 30, marks)} {passage} {prose(r, 30, marks)}") for i in range(12)]
        rows += [(100 + i, f"{prose(r, 30, marks)} {line} {prose(r, 30, marks)}") for i in range(12)]
        out = {x.doc_id: x.n_removed for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[0] == 0 and all(out[i] > 0 for i in range(1, 12)), marks
        assert not any(out[100 + i] for i in range(12))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(frame).count() == 0


def test_bitmap_misses_nothing(spark, monkeypatch):
    """With few bits nearly every run is sent on; the result is the same."""
    r = random.Random(5)
    passage = prose(r, 80)
    frame = spark.createDataFrame([(i, f"{prose(r, 40)} {passage} {prose(r, 40)}") for i in range(6)], "doc_id long, text string")
    want = sorted(S.remove_repeats(frame).collect())
    monkeypatch.setattr(bitmaps, "BITS", bitmaps.SEGMENT)
    assert sorted(S.remove_repeats(frame).collect()) == want
