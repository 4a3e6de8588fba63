"""Census of the attribute vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def census(attrs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """`(key, value, doc_count)`; with `docs`, only their attributes count and pairs without any are absent."""
    if docs is not None:
        attrs = attrs.join(docs.select("doc_id"), "doc_id", "left_semi")
    return attrs.groupBy("key", "value").agg(F.count(F.lit(1)).alias("doc_count"))


def report(counts: DataFrame, limit: int = 0) -> DataFrame:
    """`(key, occurrences, distinct_values, truncated, values)` by occurrences, then key.

    values has `(value, doc_count)` by count, then value; at most `limit` of them unless that is 0 or less.
    Values are ranked by a window before they are gathered, so a key with very many values gathers `limit`.
    """
    w = Window.partitionBy("key").orderBy(F.desc("doc_count"), "value")
    ranked = counts.withColumn("r", F.row_number().over(w))
    shown = F.collect_list(F.when(F.lit(limit <= 0) | (F.col("r") <= limit), F.struct("r", "value", "doc_count")))
    return (
        ranked.groupBy("key")
        .agg(F.sum("doc_count").alias("occurrences"), F.count(F.lit(1)).alias("distinct_values"), F.array_sort(shown).alias("v"))
        .select(
            "key",
            "occurrences",
            "distinct_values",
            (F.col("distinct_values") > F.size("v")).alias("truncated"),
            F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["doc_count"].alias("doc_count"))).alias("values"),
        )
        .orderBy(F.desc("occurrences"), "key")
    )


def values_of(attrs: DataFrame, key: str) -> DataFrame:
    """The distinct values of one key, sorted."""
    return attrs.where(F.col("key") == key.strip().lower()).select("value").distinct().orderBy("value")
