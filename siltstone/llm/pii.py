"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, schemes and the words that announce an
identifier. From each anchor a small deterministic parser walks outwards over fixed character classes and validates
what it has bounded. Addresses and card numbers have no literal anchor; their anchor is a digit followed by what joins
digit runs, found by one scan. Every parser is linear in the text, also where a long run of letters would make a
backtracking expression quadratic.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed expressions; what fails its
check is dropped and its characters stay consumed. The method adds kinds of its own: url (anchored at a scheme), iban
(anchored at a country's code with a valid checksum) and account (anchored at a cue word such as "account no"). Spans are in code
points, end exclusive.

Defined cases: a null text counts as empty and has no spans; kinds may overlap each other; other columns are ignored;
a text of any length is searched whole; rows are independent, so repeated rows have equal results.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Starts at the first digit of a run only: from a later one it fails alike, and trying each would be quadratic.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_URL = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[\x20\t]*(?:no|nr|number|num|id)\b\.?)?[\x20\t]*[:#=]?[\x20\t]*([0-9][0-9-]{4,32}[0-9])(?![A-Za-z0-9])", re.I)
_SCHEMES = ("http://", "https://", "ftp://")
_CUES = ("account", "acct", "ssn", "passport", "customer", "konto", "compte", "cuenta")


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign, kind in (("@", "email"), ("+", "phone")):
        found.add_word(sign, (kind, 1))
    for kind, words in (("url", _SCHEMES), ("account", _CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, in order of start."""
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    used = dict.fromkeys(KINDS, 0)
    for end, (kind, length) in _automaton().iter(text):
        at = end - length + 1
        if at < used[kind]:
            continue
        if kind == "email":
            start = at
            while start > used[kind] and text[start - 1] in _LOCAL:
                start -= 1
            m = _LABEL.match(text, end + 1) if start < at else None
            if m:
                spans[kind].append((start, m.end()))
                used[kind] = m.end()
            else:
                used[kind] = max(used[kind], at)  # a later local part cannot reach back over an at-sign
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                used[kind] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans[kind].append(m.span())
        elif kind == "url":
            m = _URL.match(text, end + 1)
            if m:
                stop = m.start() + len(m[0].rstrip(".,;:!?'()[]"))
                if stop > end + 1:
                    spans[kind].append((at, stop))
                    used[kind] = stop
        else:
            m = _ACCOUNT.match(text, end + 1)
            if m:
                spans[kind].append(m.span(1))
                used[kind] = m.end(1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append(m.span())
    for m in _IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and _iban_valid(m[0]) and not text[max(0, m.start() - 1) : m.start()].isalnum():
            spans["iban"].append(m.span())
    return spans


def joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    """The text with each span replaced by its kind; where spans overlap the earlier, then longer one counts."""
    if text is None:
        return None
    found = find(text)
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k in kinds for a, b in found[k]), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


_RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


@F.pandas_udf(_RESULT)
def found_in(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Counts by kind, the digest of the base spans and all spans of each text."""
    for batch in texts:
        rows = []
        for text in batch:
            spans = find(text or "")
            base = joined(spans, BASE)
            rows.append((*(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans, KINDS)))
        yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


@F.pandas_udf(T.StringType())
def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: redact(t), na_action="ignore")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = docs.select(F.col(id_col).alias("doc_id"), found_in(F.col(text_col)).alias("found"))
    return found.select("doc_id", *(f"found.n_{k}" for k in BASE), "found.base_sha256", "found.spans")


def op2_anchor_expansion_pii(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
