"""Code points of texts as numpy arrays, and the classes of characters."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

LOWER, UPPER, LETTER, DIGIT, SPACE, LINE, STOP, PAUSE, SHOUT, BAR, MARK, OTHER = range(12)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """A class for each code point."""
    kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT} | dict.fromkeys(("Lo", "Lm", "Mn", "Mc"), LETTER) | dict.fromkeys(("Zs", "Zl", "Zp"), SPACE)
    out = np.fromiter((kinds.get(unicodedata.category(chr(c)), OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, signs in ((SPACE, "\t\r\x0b\x0c"), (LINE, "\n"), (STOP, ".?;:"), (PAUSE, ",'\"-()"), (SHOUT, "!"), (BAR, "|"), (MARK, "#*$%&<>@=+_/\\{}[]~^")):
        out[[ord(c) for c in signs]] = kind
    return out


def blocks(text: str | None, size: int = 1 << 16) -> Iterator[str]:
    """A text in blocks of about ``size`` characters, cut after a space or line break where there is one, so that memory is bounded."""
    text, at = text or "", 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = gap + 1 if gap > at else end
        yield text[at:end]
        at = end


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str) -> np.ndarray:
    """The lower-cased text with each run of anything but letters as one space, and a space at both ends."""
    c = points(text.lower())
    c = np.where(classes()[c] <= LETTER, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a multiplicative hash."""
    with np.errstate(over="ignore"):
        return ((h * np.uint32(2654435769)) >> np.uint32(32 - bits)).astype(np.int64)
