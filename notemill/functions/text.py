"""Text analysis in JVM expressions: word runs, identifier parts, length filter and stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import let
from .stemmer import stem_column

# The reference's English stop words.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its of on or she that the their "
    "them then there these they this to was were which will with would you your"
).split()

WORD = r"[\p{L}\p{N}]+"
#: Where an identifier splits: lower to upper, letter to digit and back, and before the last capital of an acronym.
PARTS = r"(?<=[^\p{Lu}\p{N}])(?=\p{Lu})|(?<=\p{N})(?=\P{N})|(?<=\P{N})(?=\p{N})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: Runs that surely have no inner boundary, as nearly all words.
UNBROKEN = r"^\P{N}[^\p{Lu}\p{N}]*$"
MIN_LENGTH = 2


def split_words(text: Column) -> Column:
    """Lower-cased word runs; a run with inner boundaries gives itself and then its parts."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def expand(run: Column) -> Column:
        whole = F.array(F.lower(run))
        several = lambda parts: F.when(F.size(parts) > 1, F.concat(whole, F.transform(parts, F.lower))).otherwise(whole)
        return F.when(run.rlike(UNBROKEN), whole).otherwise(let(F.split(run, PARTS), several))

    return F.flatten(F.transform(runs, expand))


def tokens(text: Column, min_length: int = MIN_LENGTH, drop_stopwords: bool = True) -> Column:
    """`split_words` without short words and stop words, unstemmed."""
    stop = STOPWORDS if drop_stopwords else []
    return F.filter(split_words(text), lambda t: (F.length(t) >= min_length) & ~t.isin(stop) if stop else F.length(t) >= min_length)


def analyse(df: DataFrame, text: str, out: str = "term", stem: bool = True, **options) -> DataFrame:
    """One row per token of column `text`, with its position; rows without tokens give none."""
    rows = df.select("*", F.posexplode(tokens(F.col(text), **options)).alias("pos", out))
    return stem_column(rows, out) if stem else rows


def analyse_query(text: str, stem_words: bool = True) -> list[str]:
    """The terms of a query string, on the driver, by the same rules."""
    import regex

    from .stemmer import stem

    out = []
    for run in regex.findall(WORD, text):
        parts = [p for p in regex.split(PARTS, run, flags=regex.V1) if p]
        for word in [run, *parts] if len(parts) > 1 else [run]:
            w = word.lower()
            if len(w) >= MIN_LENGTH and w not in STOPWORDS:
                out.append(stem(w) if stem_words else w)
    return list(dict.fromkeys(out))
