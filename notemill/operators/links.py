"""The link graph: names, resolution, backlinks, broken and ambiguous links, notes without links.

Notes are `(vault, path, title, aliases, out_links)`; a vault is a name space of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import last_segment, normalised, salted_join, trimmed

PATH, PATH_MD, STEM, TITLE, ALIAS = range(5)


def file_stem(path: Column) -> Column:
    """The last segment without its extension; a leading dot begins no extension."""
    seg = last_segment(path)
    dot = F.length(seg) - F.length(F.substring_index(seg, ".", -1))
    return F.when(dot > 1, F.substring(seg, F.lit(1), dot - 1)).otherwise(seg)


def names(notes: DataFrame) -> DataFrame:
    """`(vault, kind, name, first_path, last_path, n)`: what a link may say, one row per name.

    Aggregated, so a name that very many notes carry is one row and no later join multiplies. A note that
    lists an alias twice counts twice.
    """
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    listed = F.concat(
        F.array(entry(PATH, normalised("path")), entry(STEM, normalised(file_stem(F.col("path")))), entry(TITLE, normalised("title"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: entry(ALIAS, normalised(a))),
    )
    rows = notes.select("vault", "path", F.explode(listed).alias("e")).select("vault", "path", "e.*").where(F.col("name") != "")
    return rows.groupBy("vault", "kind", "name").agg(F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.count(F.lit(1)).alias("n"))


def outgoing(notes: DataFrame) -> DataFrame:
    """`(vault, src, pos, target, name)`: every link in document order, duplicates kept; nulls are left out."""
    rows = notes.select("vault", F.col("path").alias("src"), F.posexplode("out_links").alias("pos", "target"))
    return rows.where(F.col("target").isNotNull()).withColumn("name", normalised("target"))


def resolve_names(targets: DataFrame, known: DataFrame) -> DataFrame:
    """`(vault, name, n_links, resolved, candidates)` of distinct normalised targets.

    A target is tried as a path, with `.md`, as a stem, a title and an alias; the first class with a note wins
    and the least path in it. Of paths that differ in case only the last holds.
    """
    probe = lambda prio, kind, c: F.struct(F.lit(prio).alias("prio"), F.lit(kind).alias("kind"), c.alias("key"))
    name = F.col("name")
    md = F.when(~name.endswith(".md"), F.concat(name, F.lit(".md")))
    probes = F.array(probe(0, PATH, name), probe(1, PATH, md), probe(2, STEM, file_stem(name)), probe(3, TITLE, name), probe(4, ALIAS, name))
    asked = targets.select("vault", "name", "n_links", F.explode(probes).alias("p")).select("vault", "name", "n_links", "p.*")
    k = known.select(F.col("vault").alias("v"), F.col("kind").alias("k"), F.col("name").alias("nm"), "first_path", "last_path", "n")
    met = asked.join(k, (F.col("vault") == F.col("v")) & (F.col("kind") == F.col("k")) & (F.col("key") == F.col("nm")), "left")
    direct = F.col("kind") == PATH
    best = F.min(
        F.when(
            F.col("nm").isNotNull(),
            F.struct(
                "prio",
                F.when(direct, F.col("last_path")).otherwise(F.col("first_path")).alias("path"),
                F.when(direct, F.lit(1)).otherwise(F.col("n")).alias("n"),
            ),
        )
    )
    out = met.groupBy("vault", "name").agg(F.first("n_links").alias("n_links"), best.alias("b"))
    return out.select("vault", "name", "n_links", F.col("b.path").alias("resolved"), F.coalesce("b.n", F.lit(0)).alias("candidates"))


def resolved_links(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`(vault, src, pos, target, name, resolved, candidates)`; blank targets resolve to nothing. `known` has the `names`, where they are at hand."""
    links = outgoing(notes)
    targets = links.where(F.col("name") != "").groupBy("vault", "name").agg(F.count(F.lit(1)).alias("n_links"))
    r = resolve_names(targets, names(notes) if known is None else known)
    out = salted_join(links, r, ["vault", "name"], "n_links", how="left")
    return out.select("vault", "src", "pos", "target", "name", "resolved", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def backlinks(resolved: DataFrame) -> DataFrame:
    """`(vault, dst, src)`, distinct; links of a note to itself count."""
    return resolved.where(F.col("resolved").isNotNull()).select("vault", F.col("resolved").alias("dst"), "src").distinct()


def broken_links(resolved: DataFrame) -> DataFrame:
    """`(vault, target, referrer)`, distinct; targets are trimmed and keep their case; blank ones are never broken."""
    gone = resolved.where(F.col("resolved").isNull() & (F.col("name") != ""))
    return gone.select("vault", trimmed("target").alias("target"), F.col("src").alias("referrer")).distinct()


def ambiguous_links(resolved: DataFrame) -> DataFrame:
    """`(vault, target, referrer)`, distinct, of raw targets with more than one candidate in their class."""
    return resolved.where(F.col("candidates") > 1).select("vault", "target", F.col("src").alias("referrer")).distinct()


def unlinked_notes(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """`(vault, path)` of notes without links and without backlinks. A blank link is a link."""
    alone = notes.where(F.coalesce(F.size("out_links"), F.lit(0)) <= 0).select("vault", "path")
    seen = backlinks(resolved).select("vault", F.col("dst").alias("path")).distinct()
    return alone.join(seen, ["vault", "path"], "left_anti")


def links_to(notes: DataFrame, back: DataFrame, vault: str, path: str) -> DataFrame:
    """`(path, title)` of the notes that link to one note, by path; `back` has the `backlinks`."""
    mine = back.where((F.col("vault") == vault) & (F.col("dst") == path)).select("vault", F.col("src").alias("path"))
    return notes.join(mine, ["vault", "path"], "left_semi").select("path", "title").orderBy("path")


def links_from(resolved: DataFrame, vault: str, path: str) -> DataFrame:
    """`(target, resolvedPath)` of one note's links in document order, duplicates kept."""
    mine = resolved.where((F.col("vault") == vault) & (F.col("src") == path)).orderBy("pos")
    return mine.select("target", F.col("resolved").alias("resolvedPath"))


def by_target(pairs: DataFrame) -> DataFrame:
    """`(vault, target, referrers)`: the referrers of a target, sorted, in one row as reports show them."""
    return pairs.groupBy("vault", "target").agg(F.array_sort(F.collect_set("referrer")).alias("referrers"))


def candidates_of(notes: DataFrame, argument: str) -> DataFrame:
    """`(vault, path)` of all notes that any class of names gives for an argument, to list an ambiguity."""
    name = argument.strip().lower()
    stem = name.rsplit("/", 1)[-1]
    stem = stem[: stem.rfind(".")] if stem.rfind(".") > 0 else stem
    any_alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: normalised(a) == name)
    hit = (
        normalised("path").isin([name, name + ".md"])
        | (normalised(file_stem(F.col("path"))) == stem)
        | (normalised("title") == name)
        | any_alias
    )
    return notes.where(hit).select("vault", "path").distinct().orderBy("vault", "path")
