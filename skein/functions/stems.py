"""Porter's stems of English words (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of the published algorithm, by step.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """`v` or `c` for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last none of w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    fits = [r for r in rules if word.endswith(r[0])]
    if not fits:
        return word
    end, new = max(fits, key=lambda r: len(r[0]))
    return word[: -len(end)] + new if _measure(word[: -len(end)]) > 0 else word


def _inflection(w: str) -> str:
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _kinds(w[: -len(e)])), None)
        if cut is not None:
            w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if _doubled(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    return w[:-1] + "i" if w.endswith("y") and "v" in _kinds(w[:-1]) else w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case; marks on letters go, words of two letters or of more than 64 stay."""
    w = "".join(x for x in unicodedata.normalize("NFD", word) if not unicodedata.combining(x))
    if not 2 < len(w) <= 64:
        return w
    w = _replaced(_replaced(_inflection(w), STEP_2), STEP_3)
    fits = [e for e in STEP_4 if w.endswith(e)]
    if fits:
        cut = w[: -len(max(fits, key=len))]
        if _measure(cut) > 1 and (not w.endswith("ion") or cut.endswith(("s", "t"))):
            w = cut
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda x: None if x is None else stem(x))


def stemmed(words: Column) -> Column:
    return F.pandas_udf(_stems, "string")(words)
