"""References to records that do not exist.

Method: the distinct foreign keys of all tables meet the names of existing records in distributed left
anti joins; what is left is joined back to the references, for the rows and for counts per table and
period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, month_of_millis, month_of_timestamp, normalised, salted_join, stem_of, trimmed

#: References a row of which has these: the kind of names it may mean, the space they live in, the period.
KEY = ["tbl", "vault", "name", "ym"]


def note_references(notes: DataFrame) -> DataFrame:
    """`(tbl, vault, name, ym, row_id, target)`: the non-blank elements of `notes.out_links`.

    Null and empty arrays and null elements give nothing; a null mtime_ms gives the period null.
    """
    raw = notes.select(
        F.col("vault"), month_of_millis("mtime_ms").alias("ym"), F.col("note_id").alias("row_id"), F.explode("out_links").alias("raw")
    )
    target = trimmed("raw")
    return raw.where(target != "").select(
        F.lit("notes").alias("tbl"), "vault", normalised("raw").alias("name"), "ym", "row_id", target.alias("target")
    )


def edit_references(edits: DataFrame) -> DataFrame:
    """The same columns for the non-null `edits.path`."""
    return edits.where(F.col("path").isNotNull()).select(
        F.lit("edits").alias("tbl"),
        "vault",
        normalised("path").alias("name"),
        month_of_timestamp("ts").alias("ym"),
        F.col("edit_id").alias("row_id"),
        trimmed("path").alias("target"),
    )


def record_names(notes: DataFrame) -> DataFrame:
    """`(kind, p_vault, p_name, from_ym, to_ym)`: distinct names with the months in which they hold.

    kind `name` has what an out_link may equal (path, path without `.md`, title, alias), `stem` the
    stems of paths, `path` the whole paths. Months are pre-aggregated, so a name that a third of all notes
    carry is a few rows here.
    """
    path = normalised("path")
    bare = F.when(path.endswith(".md"), F.substring(path, F.lit(1), F.length(path) - 3))
    names = F.concat(
        F.array(
            F.struct(F.lit("path").alias("kind"), path.alias("p_name")),
            F.struct(F.lit("name").alias("kind"), path.alias("p_name")),
            F.struct(F.lit("name").alias("kind"), bare.alias("p_name")),
            F.struct(F.lit("name").alias("kind"), normalised("title").alias("p_name")),
            F.struct(F.lit("stem").alias("kind"), trimmed(stem_of(path)).alias("p_name")),
        ),
        F.transform(
            F.coalesce("aliases", F.array().cast("array<string>")),
            lambda a: F.struct(F.lit("name").alias("kind"), normalised(a).alias("p_name")),
        ),
    )
    return (
        notes.where(F.col("added").isNotNull())
        .select(
            F.col("vault").alias("p_vault"),
            month_of_timestamp("added").alias("from_ym"),
            month_of_timestamp("removed").alias("to_ym"),
            F.explode(names).alias("n"),
        )
        .where(F.col("n.p_name").isNotNull())
        .select(F.col("n.kind").alias("kind"), "p_vault", F.col("n.p_name").alias("p_name"), "from_ym", "to_ym")
        .distinct()
    )


def reference_keys(refs: DataFrame) -> DataFrame:
    """Distinct foreign keys with `n_refs`, how many references have each (partial sums before the shuffle)."""
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_refs"))


def orphan_keys(keys: DataFrame, names: DataFrame) -> DataFrame:
    """The keys that name no record existing in their period, by two left anti joins.

    Null vaults and periods match nothing, so such references are orphans.
    """
    exists = (F.col("from_ym") <= F.col("ym")) & (F.col("to_ym").isNull() | (F.col("to_ym") > F.col("ym")))
    same = F.col("p_vault") == F.col("vault")
    kind = F.when(F.col("tbl") == "notes", F.lit("name")).otherwise(F.lit("path"))
    left = keys.withColumn("want", kind).join(
        names.where(F.col("kind") != "stem"), same & (F.col("kind") == F.col("want")) & (F.col("p_name") == F.col("name")) & exists, "left_anti"
    )
    left = left.withColumn("stem", F.when(F.col("tbl") == "notes", trimmed(stem_of(F.col("name")))))
    left = left.join(names.where(F.col("kind") == "stem"), same & (F.col("p_name") == F.col("stem")) & exists, "left_anti")
    return left.drop("want", "stem")


def all_references(notes: DataFrame, edits: DataFrame) -> DataFrame:
    return note_references(notes).unionByName(edit_references(edits))


def orphan_references(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """`(tbl, ym, row_id, target)`, distinct: every reference that names no note existing in its month."""
    refs = all_references(notes, edits)
    orphans = cut(orphan_keys(reference_keys(refs), record_names(notes)))  # for the heavy list and for the join
    return salted_join(refs, orphans, KEY, "n_refs").select("tbl", "ym", "row_id", "target").distinct()


def orphan_report(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """`(tbl, ym, n_refs, n_orphans, n_targets, n_orphan_targets)` per table and month.

    n_targets counts distinct normalised targets of a vault. Repeated rows count as often as they occur.
    """
    refs = all_references(notes, edits)
    keys = reference_keys(refs)
    orphans = orphan_keys(keys, record_names(notes)).select(*KEY, F.lit(True).alias("orphan"))
    o = orphans.select(*(F.col(c).alias(f"o_{c}") for c in KEY), "orphan")
    joined = keys.join(o, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in KEY], "left")
    return joined.groupBy("tbl", "ym").agg(
        F.sum("n_refs").alias("n_refs"),
        F.sum(F.when(F.col("orphan"), F.col("n_refs")).otherwise(0)).alias("n_orphans"),
        F.count(F.lit(1)).alias("n_targets"),
        F.count("orphan").alias("n_orphan_targets"),
    )
