"""How distinctive a term is per record.

Method: probabilistic relevance weighting (BM25): saturating term frequency, normalised by the record's
length, times an inverse document frequency taken from the whole collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import let, normalised, run_lengths, salted_join, spread, stored

K1, B = 1.2, 0.75
FOUND_TF, FOUND_DF = 4, 5


def term_frequencies(notes: DataFrame) -> DataFrame:
    """`(note_id, term, tf, dl)`; dl is the number of non-null terms of the note, all fields together.

    Counts are taken inside the row, so nothing is shuffled.
    """
    terms = F.transform(F.col("terms"), lambda t: normalised(t.getField("term")))
    both = F.struct(run_lengths(terms).alias("counts"), F.size(F.filter(F.col("terms.term"), lambda t: t.isNotNull())).alias("dl"))
    # the length goes into the elements, so that the explode carries no array along
    items = let(both, lambda s: F.transform(s["counts"], lambda x: F.struct(x["item"].alias("term"), x["n"].alias("tf"), s["dl"].alias("dl"))))
    return spread(notes.select("note_id", "terms")).select("note_id", F.explode(items).alias("c")).select("note_id", "c.term", "c.tf", "c.dl")


def relevance(tf: Column, n_notes: Column, dl: Column, n: int, avg: float, k1: float = K1, b: float = B) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avg)); rises with tf, falls with df."""
    idf = F.log(1 + (F.lit(float(n)) - n_notes + 0.5) / (n_notes + 0.5))
    norm = F.lit(1 - b) + F.lit(b) * dl / F.lit(avg) if avg > 0 else F.lit(1.0)
    return idf * tf * (k1 + 1) / (tf + F.lit(k1) * norm)


def _scored(notes: DataFrame, k1: float, b: float) -> tuple[DataFrame, int, float]:
    """`(note_id, term, tf, dl, n_notes, score)`, the number of notes and their mean length."""
    tf = stored(term_frequencies(notes))  # made once, for the document frequencies and for the rows
    some = F.size(F.filter(F.col("terms"), lambda t: t.getField("term").isNotNull()))
    stats = notes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(some, F.lit(0))).alias("len")).first()
    n, avg = stats["n"], (stats["len"] or 0) / max(stats["n"], 1)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n_notes"))
    both = salted_join(tf, df, ["term"], "n_notes")
    score = relevance(F.col("tf"), F.col("n_notes"), F.col("dl"), n, avg, k1, b)
    return both.select("note_id", "term", "tf", "dl", "n_notes", score.alias("score")), n, avg


def distinctive_terms(notes: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """`(note_id, term, tf, n_notes, score)` for every distinct normalised term of every note.

    score is the `relevance`. N counts every row of notes, those without terms too; avg is the mean dl over them. A
    repeated row counts as a further note in N and df and gives its rows again. Frequent terms are joined under salts.
    """
    return _scored(notes, k1, b)[0].drop("dl")


def characteristic_terms(notes: DataFrame) -> DataFrame:
    """`(note_id, term)`, distinct: terms that occur at least 4 times in a note and that at most 5 notes hold.

    The score decides first: it rises with tf and falls with df, so no such term scores less than one with tf 4 and df 5
    in a note of the same length. Frequency and document frequency of what is left follow exactly.
    """
    scored, n, avg = _scored(notes, K1, B)
    least = relevance(F.lit(FOUND_TF), F.lit(FOUND_DF), F.col("dl"), n, avg)
    high = scored.where(F.col("score") >= F.least(least, least * F.lit(1 - 1e-9)))  # a margin for rounding
    return high.where((F.col("tf") >= FOUND_TF) & (F.col("n_notes") <= FOUND_DF)).select("note_id", "term").distinct()
