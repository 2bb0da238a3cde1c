"""Letters, numbers and lower case as the tokenizers library has them, whatever tables Python and its regex module come with."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import normalizers

# Code points that Unicode 16 added to the letters and numbers of 15.1.
ADDED_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
                 (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
ADDED_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Fixed values: (first, last, distance) of upper-case letters that Unicode 16 and 17 added, and how far their lower case lies.
ADDED_UPPER = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
OTHER, LETTER, NUMBER = range(3)
_LOWER = {c: c + by for first, last, by in ADDED_UPPER for c in range(first, last + 1)}
_HAS_UPPER = re.compile("[" + "".join(f"{chr(first)}-{chr(last)}" for first, last, _ in ADDED_UPPER) + "]")
# Planes and blocks without marks (ideographs, Hangul syllables, private use), whose composition no version changed.
SETTLED = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xF8FF), (0x20000, 0x2F7FF), (0x2FA20, 0xDFFFF), (0xE1000, 0x10FFFF))
_tables: list[np.ndarray] = []
_differ: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """OTHER, LETTER or NUMBER of every code point."""
    if not _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        for added, kind in ((ADDED_LETTERS, LETTER), (ADDED_NUMBERS, NUMBER)):
            for first, last in added:
                table[first : last + 1] = kind
        _tables.append(table)
    return _tables[0]


def ranges_of(kind: int) -> str:
    """The code points of a class, as written between the brackets of a pattern."""
    inside = np.concatenate(([False], class_table() == kind, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


def lower(text: str) -> str:
    if _HAS_UPPER.search(text):
        text = text.translate(_LOWER)
    return text.replace("Σ", "σ").lower()


def composition_differs() -> np.ndarray:
    """Whether a code point is composed, decomposed or ordered otherwise by the library than by Python's tables."""
    if not _differ:
        differ = np.zeros(0x110000, bool)
        look = np.ones(0x110000, bool)
        for first, last in SETTLED:
            look[first : last + 1] = False
        look[:0x80] = False
        points = np.flatnonzero(look)
        letters = [chr(c) for c in points.tolist()]
        for form in ("NFC", "NFD"):
            library = getattr(normalizers, form)()
            # alone, before a mark of the lowest class, and behind one of the highest: a class that only one side knows moves it
            for before, after in (("", ""), ("x", "\u0334"), ("x\u0345", "")):
                whole = "\n".join(before + c + after for c in letters)
                own, other = unicodedata.normalize(form, whole).split("\n"), library.normalize_str(whole).split("\n")
                for c, a, b in zip(letters, own, other, strict=True):
                    if a != b:
                        differ[ord(c)] = True
                        if form == "NFD" and not before:
                            differ[[ord(x) for x in a + b if ord(x) >= 0x80]] = True  # parts of what only one side composes
        _differ.append(differ)
    return _differ[0]


def compose(text: str) -> str:
    """The canonical composition (NFC) as the library has it."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if composition_differs()[code].any():
        return normalizers.NFC().normalize_str(text)
    return unicodedata.normalize("NFC", text)
