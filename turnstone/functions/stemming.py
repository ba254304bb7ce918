"""Words as the keyword index holds them: letters and digits, lower case, no diacritics, Porter stems.

The stemmer follows M. F. Porter, "An algorithm for suffix stripping" (1980). Words are stemmed once
each: a task keeps the stems of the words it has met.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}]+")
#: Longer words are kept as they are.
LONGEST = 64
VOWELS = "aeiou"

# The paper's suffixes and what stands for them, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """v and c by letter; a y behind a consonant is a vowel."""
    out = ""
    for ch in stem:
        out += "v" if ch in VOWELS or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _past(word: str) -> str:
    for end in ("ed", "ing"):
        stem = word[: -len(end)]
        if word.endswith(end) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


def _replaced(word: str, rules) -> str:
    """The longest suffix that fits decides, whether or not its condition holds."""
    fits = [r for r in rules if word.endswith(r[0])]
    if not fits:
        return word
    end, by = max(fits, key=lambda r: len(r[0]))
    stem = word[: -len(end)]
    return stem + by if _measure(stem) > 0 else word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Of a word in lower case."""
    if not 2 < len(word) < LONGEST or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    fits = [e for e in STEP_4 if word.endswith(e)]
    if fits:
        end = max(fits, key=len)
        rest = word[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def plain(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    marked = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(c for c in marked if not unicodedata.combining(c))).lower()


def words(text: str | None) -> list[str]:
    return TOKEN.findall(plain(text or ""))


def tokens(text: str | None) -> list[str]:
    return [stem(w) for w in words(text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(text: pd.Series) -> pd.Series:
    return text.map(tokens)
