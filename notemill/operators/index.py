"""From notes to the tables of an index: field terms, postings, documents, attributes, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import FORMAT_VERSION
from ..common import normalised, run_lengths, spread
from ..functions.stemmer import stem_column
from ..functions.text import tokens

# The reference's default weights.
FIELD_WEIGHTS = {"title": 3.0, "alias": 3.0, "heading": 2.0, "tag": 2.0, "body": 1.0}

_NONE = "array<string>"


def _or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(_NONE))


def field_terms(parsed: DataFrame, stem: bool = True, **options) -> DataFrame:
    """`(doc_id, term, field, n)`, n occurrences of a word each, of notes `(doc_id, title, aliases, headings, tags, body)`.

    Words are counted and stemmed where the rows are; nothing moves. A tag with `/` is a term as it stands, and its parts are analysed too.
    """
    each = lambda texts: F.flatten(F.transform(_or_empty(texts), lambda t: tokens(t, **options)))
    tagged = lambda a, f: F.transform(run_lengths(a), lambda t: F.struct(t["item"].alias("term"), F.lit(f).alias("field"), F.lit(True).alias("stems"), t["n"].alias("n")))
    tags = F.array_distinct(F.filter(F.transform(_or_empty("tags"), normalised), lambda t: t != ""))
    whole = F.transform(
        F.filter(tags, lambda t: t.contains("/")), lambda t: F.struct(t.alias("term"), F.lit("tag").alias("field"), F.lit(False).alias("stems"), F.lit(1).alias("n"))
    )
    fields = F.concat(
        tagged(tokens(F.col("title"), **options), "title"),
        tagged(each("aliases"), "alias"),
        tagged(each("headings"), "heading"),
        whole,
        tagged(each(F.flatten(F.transform(tags, lambda t: F.split(t, "/")))), "tag"),
        tagged(tokens(F.col("body"), **options), "body"),
    )
    source = spread(parsed.select("doc_id", "title", "aliases", "headings", "tags", "body"))
    rows = source.select("doc_id", F.explode(fields).alias("t")).select("doc_id", "t.term", "t.field", "t.stems", "t.n")
    if stem:
        rows = stem_column(rows.withColumn("word", F.when(F.col("stems"), F.col("term"))), "word")
        rows = rows.withColumn("term", F.coalesce("word", "term"))
    return rows.select("doc_id", "term", "field", "n")


def indexed_terms(notes: DataFrame) -> DataFrame:
    """`(doc_id, term, field, n)` of notes that carry their terms already; null terms are left out."""
    rows = notes.select(F.col("note_id").alias("doc_id"), F.explode("terms").alias("t"))
    return rows.where(F.col("t.term").isNotNull()).select("doc_id", normalised("t.term").alias("term"), F.col("t.field").alias("field"), F.lit(1).alias("n"))


def postings(terms: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`(term, doc_id, wtf)`: the weights of all occurrences added, rounded half up, at least 1."""
    weights = FIELD_WEIGHTS | (weights or {})
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("field")), F.lit(1.0))
    total = F.greatest(F.lit(1), F.round(F.sum(weight * F.col("n"))).cast("int"))
    return terms.groupBy("term", "doc_id").agg(total.alias("wtf"))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        n = pc.list_value_length(t.column("terms")).to_numpy()
        words = t.column("terms").flatten().dictionary_encode()
        width = max(1, len(words.dictionary))
        key, at = np.unique(np.repeat(np.arange(len(n)), n) * width + words.indices.to_numpy(), return_inverse=True)
        total = np.bincount(at, t.column("weights").flatten().to_numpy(), len(key))
        ends = np.append(0, np.cumsum(np.bincount(key // width, minlength=len(n)))).astype(np.int32)
        terms = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(key % width)))
        wtf = pa.ListArray.from_arrays(ends, np.maximum(1, np.floor(total + 0.5)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("path"), pa.array(n.astype(np.int32)), terms, wtf], ["doc_id", "path", "length", "terms", "wtf"])


def document_postings(notes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`(doc_id, path, length, terms, wtf)`: `postings` and `doc_lengths` of notes that carry their terms, as a row per note.

    `terms` has each distinct term once, `wtf` its weight at the same place; both are empty for notes without terms. Made inside the row, so
    nothing is shuffled, and note_id must be a key: a repeated one counts as a further document.
    """
    weights = FIELD_WEIGHTS | (weights or {})
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    some = F.coalesce(F.filter("terms", lambda t: t["term"].isNotNull()), F.array().cast("array<struct<term:string,field:string>>"))
    rows = spread(notes.select(F.col("note_id").alias("doc_id"), "path", "terms")).withColumn("t", some)
    rows = rows.select(
        "doc_id",
        "path",
        F.transform("t", lambda t: normalised(t["term"])).alias("terms"),
        F.transform("t", lambda t: F.coalesce(F.element_at(weight, t["field"]), F.lit(1.0))).alias("weights"),
    )
    key = notes.schema["note_id"].dataType.simpleString()
    return rows.mapInArrow(_weigh, f"doc_id {key}, path string, length int, terms array<string>, wtf array<int>")


def doc_lengths(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`(doc_id, length)`: unweighted occurrences in all fields, 0 for documents without terms."""
    n = terms.groupBy("doc_id").agg(F.sum("n").cast("int").alias("length"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: format version, documents, average length over all of them (0 for none), terms, postings."""
    a = lengths.agg(
        F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.try_divide(F.sum("length"), F.count(F.lit(1))), F.lit(0.0)).alias("avg_length")
    )
    b = posted.agg(F.countDistinct("term").alias("term_count"), F.count(F.lit(1)).alias("posting_count"))
    one = F.lit(1)
    return (
        a.withColumn("one", one)
        .join(b.withColumn("one", one), "one")
        .select(F.lit(FORMAT_VERSION).alias("format_version"), "doc_count", "avg_length", "term_count", "posting_count")
    )


def attributes(notes: DataFrame, key: str = "doc_id", only: list[str] | None = None) -> DataFrame:
    """`(doc_id, key, value)`, distinct: attributes in long form, keys and values normalised, blanks left out.

    `only` restricts the keys that can be filtered on.
    """
    rows = notes.select(F.col(key).alias("doc_id"), F.explode("attributes").alias("key", "values"))
    rows = rows.select("doc_id", normalised("key").alias("key"), F.explode("values").alias("v"))
    rows = rows.select("doc_id", "key", normalised("v").alias("value")).where((F.col("key") != "") & (F.col("value") != ""))
    if only is not None:
        rows = rows.where(F.col("key").isin([k.strip().lower() for k in only]))
    return rows.distinct()
