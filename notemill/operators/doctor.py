"""Health reports over whole vaults. A prefix narrows what is reported, never what links resolve against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, normalised
from . import links

OVERSIZED_WORDS = 1200


def _within(df: DataFrame, col: str, prefix: str | None) -> DataFrame:
    return df.where(F.col(col).startswith(prefix)) if prefix else df


def name_collisions(notes: DataFrame, prefix: str | None = None) -> DataFrame:
    """`(vault, name, path)`: titles and aliases that more than one note carries, with all their paths.

    With a prefix, names that no note in scope carries are left out.
    """
    listed = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = notes.select("vault", "path", F.explode(F.transform(listed, lambda x: normalised(x))).alias("name")).where(F.col("name") != "").distinct()
    in_scope = F.max(F.col("path").startswith(prefix)) if prefix else F.max(F.lit(True))
    several = rows.groupBy("vault", "name").agg((F.min("path") != F.max("path")).alias("many"), in_scope.alias("ok")).where("many AND ok")
    return rows.join(several.select("vault", "name"), ["vault", "name"], "left_semi").select("vault", "name", "path")


def oversized(notes: DataFrame, threshold: int = OVERSIZED_WORDS, prefix: str | None = None) -> DataFrame:
    """`(vault, path, word_count)` above the threshold, by word count, then path."""
    big = _within(notes, "path", prefix).where(F.col("word_count") > threshold)
    return big.select("vault", "path", "word_count").orderBy(F.desc("word_count"), "vault", "path")


def malformed_frontmatter(notes: DataFrame, prefix: str | None = None) -> DataFrame:
    return _within(notes, "path", prefix).where(F.col("frontmatter_malformed")).select("vault", "path")


def frontmatter_links(notes: DataFrame, prefix: str | None = None) -> DataFrame:
    return _within(notes, "path", prefix).where(F.col("frontmatter_links")).select("vault", "path")


def report(notes: DataFrame, threshold: int = OVERSIZED_WORDS, prefix: str | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """`(finding, vault, name, path)`: all findings in long form. Links are resolved once for all of them, unless `resolved` has them."""
    resolved = cut(links.resolved_links(notes)) if resolved is None else resolved

    def found(kind: str, df: DataFrame, name: str, path: str) -> DataFrame:
        return df.select(F.lit(kind).alias("finding"), "vault", F.col(name).alias("name"), F.col(path).alias("path"))

    parts = [
        found("brokenLinks", _within(links.broken_links(resolved), "referrer", prefix), "target", "referrer"),
        found("oversized", oversized(notes, threshold, prefix).withColumn("words", F.col("word_count").cast("string")), "words", "path"),
        found("duplicateTitles", name_collisions(notes, prefix), "name", "path"),
        found("ambiguousLinks", _within(links.ambiguous_links(resolved), "referrer", prefix), "target", "referrer"),
        found("malformedFrontmatter", malformed_frontmatter(notes, prefix).withColumn("none", F.lit(None).cast("string")), "none", "path"),
        found("orphans", _within(links.unlinked_notes(notes, resolved), "path", prefix).withColumn("none", F.lit(None).cast("string")), "none", "path"),
    ]
    if "frontmatter_links" in notes.columns:
        parts.append(found("frontmatterLinks", frontmatter_links(notes, prefix).withColumn("none", F.lit(None).cast("string")), "none", "path"))
    return reduce(DataFrame.unionByName, parts)
