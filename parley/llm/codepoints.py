"""Code point arrays of texts, for operators that scan batches with numpy."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Code points scanned at once.
CHUNK = 1 << 20
#: Separates the texts of a batch; a lone surrogate cannot occur in a text.
SEPARATOR = "\ud800"
LETTER, DIGIT, OTHER, BLANK, END = range(5)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter 0, digit 1, other 2, white space 3, separator 4."""
    found = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            found[c] = LETTER
        elif kind == "N":
            found[c] = DIGIT
    # fixed values: the code points of the White_Space property
    for first, last in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        found[first:last + 1] = BLANK
    found[ord(SEPARATOR)] = END
    return found


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def in_chunks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about CHUNK code points: positions of the texts and the texts; longer texts come in several pieces."""
    places, pieces, held = [], [], 0
    for place, text in enumerate(texts):
        text = text or ""
        for start in range(0, max(len(text), 1), CHUNK):
            piece = text[start:start + CHUNK]
            places.append(place)
            pieces.append(piece)
            held += len(piece)
            if held >= CHUNK:
                yield places, pieces
                places, pieces, held = [], [], 0
    if places:
        yield places, pieces
