"""English lexemes: tokens, stop words, stems and positions, as a text search vector."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published English stop words.
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())
# The published tables of the English (Porter 2) stemmer.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LONG_STARTS = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
BEFORE_LI = "cdeghkmnrt"
VOWELS = "aeiouy"

#: Emails, hosts, decimals, compounds of words joined by hyphens, words. RE2 reads it alike.
TOKEN = r"[\p{L}\p{N}._-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]*\p{L}[\p{L}\p{N}-]*)+|[0-9]+\.[0-9]+|[\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)*"
_TOKEN = regex.compile(TOKEN)
_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_DIGIT = regex.compile(r"\p{N}")


def _ends(suffixes) -> tuple[tuple[int, frozenset[str]], ...]:
    """Suffixes by length, longest first."""
    return tuple((n, frozenset(s for s in suffixes if len(s) == n)) for n in sorted({len(s) for s in suffixes}, reverse=True))


_POSSESSIVE, _PLURAL, _PAST = _ends(("'s'", "'s", "'")), _ends(("sses", "ied", "ies", "us", "ss", "s")), _ends(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_STEP_2, _STEP_3, _STEP_4 = _ends(STEP_2), _ends(STEP_3), _ends(STEP_4)


def _longest(word: str, ends: tuple[tuple[int, frozenset[str]], ...]) -> str | None:
    for n, suffixes in ends:
        if (end := word[-n:]) in suffixes:
            return end
    return None


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def stem(word: str) -> str:
    """The English stem of a lower-case word."""
    if len(word) < 3:
        return word
    word = word.removeprefix("'")
    if word in WHOLE:
        return WHOLE[word]
    if "y" in word:
        letters = list(word)
        for i, c in enumerate(letters):
            if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
                letters[i] = "Y"
        word = "".join(letters)
    first = next(len(s) for s in LONG_STARTS if word.startswith(s)) if word.startswith(LONG_STARTS) else None
    r1 = _region(word, 0) if first is None else first
    r2 = _region(word, r1)
    word = word.removesuffix(_longest(word, _POSSESSIVE) or "")

    end = _longest(word, _PLURAL)
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and _VOWEL.search(word, 0, len(word) - 2):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    end = _longest(word, _PAST)
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word, 0, len(word) - len(end)):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] in "bdfgmnprt":
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, _STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple(BEFORE_LI)):
            word = before + STEP_2[end]
    end = _longest(word, _STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, _STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@lru_cache(1 << 16)
def lexeme(token: str) -> str | None:
    """The lexeme of a lower-case token, null for a stop word. Tokens with digits, emails and hosts stay as they are."""
    if token in STOP_WORDS:
        return None
    return stem(token) if token.isalpha() or not ("@" in token or "." in token or _DIGIT.search(token)) else token


def tokens(text: str | None) -> list[str]:
    """The lower-case tokens of a text, compounds whole."""
    text = (text or "").lower()
    if text.isalpha() or text[:-1].isalpha() and text[-1] in ",.;:!?":  # a word of letters
        return [text.rstrip(",.;:!?")]
    return _TOKEN.findall(text)


def parts_of(token: str) -> tuple[str, ...]:
    """The token, and the parts of a compound after it: each takes a position."""
    return (token,) if "@" in token or "." in token or "-" not in token else (token, *token.split("-"))


def located(text: str | None) -> list[tuple[str, int]]:
    """(lexeme, position from 1) of a text. A compound counts as itself, then as its parts; stop words take a position and are left out."""
    out, at = [], 0
    for token in tokens(text):
        for part in parts_of(token):
            at += 1
            found = lexeme(part)
            if found is not None:
                out.append((found, at))
    return out


def vector(text: str | None) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for word, at in located(text):
        out.setdefault(word, []).append(at)
    return out


VECTOR = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


@F.arrow_udf(VECTOR)
def search_vector(text: pa.Array) -> pa.Array:
    """The lexemes of a text in order of the alphabet, each with its positions. Null and empty texts have none."""
    counts, words, sizes, positions = [0], [], [0], []
    for t in text.to_pylist():
        for word, at in sorted(vector(t).items()):
            words.append(word)
            positions += at
            sizes.append(len(positions))
        counts.append(len(words))
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(positions, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.string()), lists], ["lexeme", "positions"]))
