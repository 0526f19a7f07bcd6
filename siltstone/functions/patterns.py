"""Globs and regular expressions in the dialect of filters, as Java regular expressions."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str, ignore_case: bool = False) -> str:
    """An anchored expression: * is any run, ? any character, all else itself."""
    parts = {"*": "[^\\n]*", "?": "[^\\n]"}
    body = "".join(parts.get(c, re.escape(c) if c.isascii() else c) for c in pattern)
    return ("(?iu)" if ignore_case else "") + f"\\A{body}\\z"


def _scan(pattern: str):
    """Yield (place, kind, text) of the pieces that the two dialects read differently."""
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            yield i, "escape-in-class" if in_class else "escape", pattern[i : i + 2]
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                yield i, "plain", "[^"
                i += 2
            else:
                yield i, "plain", "["
                i += 1
            if pattern[i : i + 1] == "]":
                yield i, "plain", "\\]"
                i += 1
            continue
        elif c == "$":
            yield i, "end", c
            i += 1
            continue
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            yield i, "group", pattern[i : i + 4]
            yield i, "plain", "(?"
            i += 2
            continue
        yield i, "plain", c
        i += 1


def java_regex(pattern: str) -> str | None:
    """The expression for an unanchored search in Java, or None where the dialect of filters has no such pattern.

    Look-around and back references are not part of the dialect. There, $ is the very end, . stops only at line feeds,
    and classes and case are Unicode's.
    """
    out = []
    multiline = re.search(r"\(\?[a-z]*m", pattern) is not None
    for _, kind, piece in _scan(pattern):
        if kind == "escape":
            if piece[1].isdigit():
                return None
            if piece == "\\Z":
                return None
            out.append(piece)
        elif kind == "end":
            out.append("$" if multiline else "\\z")
        elif kind == "group":
            if piece[2:3] in ("=", "!") or piece[2:4] in ("<=", "<!") or piece[2:3] == ">":
                return None
        else:
            out.append(piece)
    found = "".join(out)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\\[pP](\{[^}]*\}|.)", "a", re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", found))))
    except re.error:
        return None
    return "(?dU)" + found
