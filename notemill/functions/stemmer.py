"""English suffix stripping with the reference's variation of the classic algorithm: where a suffix fails its
condition the later suffixes of the step are still tried. Runs once per distinct word of a batch (see `stem_column`)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the algorithm: suffix and what replaces it, in the order in which they are tried.
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
QUALITY = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

_RUNS = re.compile(r"(C+)|(V+)")


def _pattern(word: str) -> str:
    """C or V per letter; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        out.append("V" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "C") else "C")
    return "".join(out)


def measure(word: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    return len(re.findall(r"V+C+", _pattern(word)))


def _twin(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "C"


def _short(word: str) -> bool:
    return _pattern(word)[-3:] == "CVC" and word[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    for suffix, new in rules.items():
        if word.endswith(suffix) and measure(word[: -len(suffix)]) >= least:
            return word[: -len(suffix)] + new
    return word


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if not cut or "V" not in _pattern(w[:-cut]):
        return w
    w = w[:-cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _twin(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and _short(w) else w


def _drop(w: str) -> str:
    cut = _replace(w, dict.fromkeys(DROPPED, ""), 2)
    if cut == w and w.endswith(("sion", "tion")) and measure(w[:-3]) > 1:
        return w[:-3]
    return cut


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "V" in _pattern(w[:-1]):
        w = w[:-1] + "i"
    return _tidy(_drop(_replace(_replace(w, DERIVED, 1), QUALITY, 1)))


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    at, distinct = pd.factorize(words)
    stems = [stem(w) for w in distinct] + [None]  # the last for nulls, whose place is -1
    return pd.Series([stems[i] for i in at], dtype=object)


def stem_column(df: DataFrame, col: str) -> DataFrame:
    """`df` with the words of `col` stemmed where the rows are; each distinct word of an Arrow batch is stemmed once. Nulls stay."""
    return df.withColumn(col, stem_udf(col))
