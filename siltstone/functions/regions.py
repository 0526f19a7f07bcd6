"""What the Snowball descriptions share: regions of a word, and the longest of some endings."""

from __future__ import annotations

from collections.abc import Iterable


def after_vc(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    i, n = start, len(word)
    while i < n and word[i] not in vowels:
        i += 1
    while i < n and word[i] in vowels:
        i += 1
    return min(i + 1, n)


def longest(word: str, suffixes: Iterable[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


class Stem:
    """A word with its regions: where they begin stays, the word gets shorter."""

    def __init__(self, word: str, vowels: str, rv: int):
        self.w, self.vowels, self.rv = word, vowels, rv
        self.r1 = after_vc(word, vowels)
        self.r2 = after_vc(word, vowels, self.r1)

    def within(self, start: int, suffixes: Iterable[str]) -> str:
        """The longest ending that lies in a region."""
        return longest(self.w[start:], suffixes)

    def drop(self, suffix: str, start: int = 0, new: str = "") -> bool:
        """Replace an ending if it is there and in a region."""
        if not suffix or not self.w.endswith(suffix) or len(self.w) - len(suffix) < start:
            return False
        self.w = self.w[: len(self.w) - len(suffix)] + new
        return True

    def drop_any(self, suffixes: Iterable[str], start: int = 0) -> str:
        """Drop the longest of some endings if it is in a region; the ending dropped."""
        found = longest(self.w, suffixes)
        return found if self.drop(found, start) else ""
