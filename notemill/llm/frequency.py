"""Frequency of every distinct term and attribute value.

Method: heavy-light aggregation. Items detected as heavy are broadcast; each task counts them exactly in
local counter arrays and sends one number per item. Only the remaining, light items go through the shuffle
with their pre-aggregated counts. One aggregation adds both up, the counters of all tasks and the light items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import normalised, run_lengths, spread, trimmed

#: Most items on the broadcast list, whatever the size of the data.
HEAVY_ITEMS = 4096
#: Longest item on it, in bytes, so that the list stays below a megabyte.
HEAVY_BYTES = 200
#: Rows looked at to guess which items are heavy. A wrong guess costs time and changes no count.
DETECT_ROWS = 20_000
RARE_BELOW, COMMON_SHARE = 3, 0.3

_TERM, _ATTRIBUTE = "t", "a"


def record_items(notes: DataFrame) -> DataFrame:
    """One row per note with `items`: array of (item, n), item prefixed by its kind, distinct in the note.

    Terms are normalised; attributes are the normalised key, `=`, the normalised non-blank value. Null
    arrays, maps, structs, terms and values give nothing.
    """
    terms = F.transform(F.col("terms"), lambda t: F.concat(F.lit(_TERM), normalised(t.getField("term"))))
    pairs = F.flatten(
        F.transform(
            F.map_entries("attributes"),
            lambda e: F.transform(
                F.filter(F.coalesce(e["value"], F.array().cast("array<string>")), lambda v: trimmed(v) != ""),
                lambda v: F.concat(F.lit(_ATTRIBUTE), normalised(e["key"]), F.lit("="), normalised(v)),
            ),
        )
    )
    none = F.array().cast("array<string>")
    return notes.select(run_lengths(F.concat(F.coalesce(terms, none), F.coalesce(pairs, none))).alias("items"))


def heavy_items(notes: DataFrame, n_rows: int, most: int = HEAVY_ITEMS, detect_rows: int = DETECT_ROWS) -> list[str]:
    """Up to `most` items of at most HEAVY_BYTES that many records of a seeded sample of the notes hold."""
    sample = notes if n_rows <= detect_rows else notes.sample(detect_rows / n_rows, seed=11)
    top = (
        record_items(sample)
        .select(F.explode("items.item").alias("item"))
        .where(F.octet_length("item") <= HEAVY_BYTES)
        .groupBy("item")
        .count()
        .where(F.col("count") >= 8)
        .orderBy(F.desc("count"), "item")
        .limit(most)
    )
    return [r["item"] for r in top.collect()]


def _counter(heavy: list[str]):
    """Per task: exact counters for heavy items, counts summed within each batch for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(heavy, pa.string())
        occurrences, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for batch in batches:
            flat = batch.column(0).flatten()  # null rows give no element
            item, n = flat.field("item").cast(pa.string()), flat.field("n").cast(pa.int64())
            at = pc.index_in(item, value_set=keys)
            hit = pc.is_valid(at)
            where = at.drop_null().to_numpy()
            occurrences += np.bincount(where, n.filter(hit).to_numpy(), len(heavy)).astype(np.int64)
            records += np.bincount(where, minlength=len(heavy))
            light = pa.table({"item": item, "n": n}).filter(pc.invert(hit)).group_by("item").aggregate([("n", "sum"), ("n", "count")])
            for b in light.select(["item", "n_sum", "n_count"]).to_batches():
                yield pa.RecordBatch.from_arrays(b.columns, names=["item", "occurrences", "records"])
        held = np.flatnonzero(records)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(held)), pa.array(occurrences[held]), pa.array(records[held])], names=["item", "occurrences", "records"]
            )

    return run


def item_counts(notes: DataFrame, most: int = HEAVY_ITEMS, detect_rows: int = DETECT_ROWS) -> DataFrame:
    """`(item_kind, item, n_occurrences, n_notes, mark)` of every distinct term and attribute value.

    Every row of notes is a record, a repeated row a further one. mark is `rare` below 3 notes, `common`
    above 30 percent of all rows of notes, else null. An empty table gives no row. Counts are exact for any
    `most` and `detect_rows`: these only choose which items are counted without a shuffle.
    """
    n_rows = notes.count()
    source = spread(notes.select("terms", "attributes"))
    counted = record_items(source).mapInArrow(_counter(heavy_items(source, n_rows, most, detect_rows)), "item string, occurrences long, records long")
    total = counted.groupBy("item").agg(F.sum("occurrences").alias("n_occurrences"), F.sum("records").alias("n_notes"))
    mark = F.when(F.col("n_notes") < RARE_BELOW, "rare").when(F.col("n_notes") > F.lit(COMMON_SHARE) * n_rows, "common")
    return total.select(
        F.when(F.substring("item", 1, 1) == _TERM, "term").otherwise("attribute").alias("item_kind"),
        F.expr("substring(item, 2)").alias("item"),
        "n_occurrences",
        "n_notes",
        mark.alias("mark"),
    )


def marked_items(notes: DataFrame) -> DataFrame:
    """`(item_kind, item, mark)` of the items too rare or too common to be useful."""
    return item_counts(notes).where(F.col("mark").isNotNull()).select("item_kind", "item", "mark")
