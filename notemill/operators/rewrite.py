"""Renames and deletes that keep the link graph whole: planned as a query, applied to a table or to files."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..common import normalised
from ..errors import NotemillError
from ..sources.vault import BOM
from . import links

_NONE = "string"


def normalise_destination(source: str, to: str, is_folder=lambda path: False) -> str:
    """`to` as a path of the vault: `.md` is added, a bare name keeps the folder, a folder keeps the file name."""
    parts = [p for p in to.replace(os.sep, "/").split("/") if p not in ("", ".")]
    path, name = "/".join(parts), source.rsplit("/", 1)[-1]
    if to.endswith(("/", os.sep)) or (path and is_folder(path)):
        return f"{path}/{name}" if path else name
    path = path if path.lower().endswith(".md") else path + ".md"
    return path if "/" in path or "/" not in source else f"{source.rsplit('/', 1)[0]}/{path}"


def _basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def occurrences(parsed: DataFrame) -> DataFrame:
    """`(vault, path, start, end, before, target, kind, anchor, alias, embed, t0, t1)`: links outside code with a target.

    `parsed` has the columns of `parse_notes` with vault, path and the note's text; start and end count from
    the text's beginning, t0 and t1 hold the raw target of a Markdown link from the link's.
    """
    base = parsed.select("vault", "path", "text", "body_at", "wiki", "links")
    null = lambda kind: F.lit(None).cast(kind)
    w = base.select("vault", "path", "text", "body_at", F.explode("wiki").alias("l")).select(
        "vault", "path", "text", "body_at", F.lit("wiki").alias("kind"), "l.target", "l.anchor", "l.alias", "l.embed", "l.start", "l.end",
        null("int").alias("t0"), null("int").alias("t1"),
    )
    m = base.select("vault", "path", "text", "body_at", F.explode("links").alias("l")).select(
        "vault", "path", "text", "body_at", F.lit("markdown").alias("kind"), "l.target", null(_NONE).alias("anchor"), F.col("l.text").alias("alias"),
        F.lit(False).alias("embed"), "l.start", "l.end",
        (F.col("l.target_start") - F.col("l.start")).alias("t0"), (F.col("l.target_end") - F.col("l.start")).alias("t1"),
    )
    rows = w.unionByName(m).where(F.col("target") != "")
    before = F.substring(F.col("text"), F.col("body_at") + F.col("start") + 1, F.col("end") - F.col("start"))
    prefix = F.substring(F.col("text"), F.lit(1), F.col("body_at") + F.col("start"))
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        "vault", "path", "kind", "target", "anchor", "alias", "embed", "t0", "t1",
        (F.col("body_at") + F.col("start")).alias("start"), (F.col("body_at") + F.col("end")).alias("end"), before.alias("before"), line.alias("line"),
    )


def _after(to: str | None) -> Column:
    """What a link becomes: its display text where the note goes, else the same style with the new target."""
    if to is None:
        return F.when(F.col("kind") == "wiki", F.coalesce("alias", "target")).otherwise(F.col("alias"))
    bare = to[:-3] if to.endswith(".md") else to
    wiki = F.concat(
        F.when(F.col("embed"), F.lit("![[")).otherwise(F.lit("[[")),
        F.when(F.col("target").contains("/"), F.lit(bare)).otherwise(F.lit(bare.rsplit("/", 1)[-1])),
        F.coalesce(F.concat(F.lit("#"), F.col("anchor")), F.lit("")),
        F.coalesce(F.concat(F.lit("|"), F.col("alias")), F.lit("")),
        F.lit("]]"),
    )
    raw = F.substring(F.col("before"), F.col("t0") + 1, F.col("t1") - F.col("t0"))
    target = F.when(raw.contains("/"), F.lit(to)).otherwise(F.lit(to.rsplit("/", 1)[-1]))
    rest = F.substring(F.col("before"), F.col("t1") + 1, F.length("before"))
    return F.when(F.col("kind") == "wiki", wiki).otherwise(F.concat(F.substring(F.col("before"), F.lit(1), F.col("t0")), target, rest))


def referrers(back: DataFrame, vault: str, source: str, to: str | None) -> DataFrame:
    """`(path)` of the notes that the index's `backlinks` know to point at `source`; of a delete without the note itself."""
    rows = back.where((F.col("vault") == vault) & (F.col("dst") == source)).select(F.col("src").alias("path"))
    return (rows if to is not None else rows.where(F.col("path") != source)).distinct()


def plan(parsed: DataFrame, notes: DataFrame, vault: str, source: str, to: str | None, known: DataFrame | None = None) -> DataFrame:
    """`(path, line, before, after, start, end)`: the edits that moving (`to`) or deleting (None) `source` needs.

    `parsed` has the texts of the `referrers`, and no others are read. Only links that resolve to the note count. A
    delete leaves the deleted note's own links alone. `known` has the `names`, where they are at hand.
    """
    mine = notes.where(F.col("vault") == vault)
    at = occurrences(parsed.where(F.col("vault") == vault)).withColumn("name", normalised("target"))
    asked = at.where(F.col("name") != "").groupBy("vault", "name").agg(F.count(F.lit(1)).alias("n_links"))
    hit = links.resolve_names(asked, links.names(mine) if known is None else known).where(F.col("resolved") == source).select("vault", "name")
    rows = at.join(hit, ["vault", "name"], "left_semi").withColumn("after", _after(to))
    if to is None:
        rows = rows.where(F.col("path") != source)
    return rows.where(F.col("before") != F.col("after")).select("path", "line", "before", "after", "start", "end")


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """`text` with every range replaced, in one forward pass."""
    out, at = [], 0
    for start, end, after in sorted(edits):
        out += [text[at:start], after]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _splice_udf(texts: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([splice(t, [(e["start"], e["end"], e["after"]) for e in es]) for t, es in zip(texts, edits)], dtype=object)


def rewritten(notes_text: DataFrame, edits: DataFrame, source: str, to: str | None) -> DataFrame:
    """`(path, text)` of one vault after the plan: a new snapshot, with the note moved or gone."""
    per_file = edits.groupBy("path").agg(F.collect_list(F.struct("start", "end", "after")).alias("edits"))
    rows = notes_text.select("path", "text").join(per_file, "path", "left")
    text = F.when(F.col("edits").isNull(), F.col("text")).otherwise(_splice_udf("text", F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,after:string>>"))))
    rows = rows.select("path", text.alias("text"))
    if to is None:
        return rows.where(F.col("path") != source)
    return rows.withColumn("path", F.when(F.col("path") == source, F.lit(to)).otherwise(F.col("path")))


def _replace_file(at: str, text: str) -> None:
    draft = f"{at}.{uuid.uuid4().hex}.draft"
    with open(draft, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    shutil.copymode(at, draft)
    os.replace(draft, at)


def _rewrite_files(root: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for path, edits in zip(part["path"], part["edits"]):
                at = os.path.join(root, path)
                if not os.path.exists(at):
                    continue
                with open(at, encoding="utf-8", newline="") as f:
                    text = f.read()
                shift = int(text.startswith(BOM))
                changes = [(e["start"] + shift, e["end"] + shift, e["before"], e["after"]) for e in edits]
                # a task that runs again after a loss finds its files changed already, and leaves them
                if all(text[a:b] == before for a, b, before, _ in changes):
                    _replace_file(at, splice(text, [(a, b, after) for a, b, _, after in changes]))
                    done.append(path)
            yield pd.DataFrame({"path": pd.Series(done, dtype=object)})

    return run


def apply_to_files(root: str, edits: DataFrame, source: str, to: str | None) -> int:
    """Rewrite the referring files, then move or delete the note; files that are gone are passed over.

    Referrers come first, so an interrupted run leaves links to a note that exists. An existing destination is
    refused. The files of the vault's shared folder are rewritten by the tasks, each replaced whole; returns how many changed.
    """
    target = os.path.join(root, to) if to else None
    if target and to != source and os.path.exists(target):
        raise NotemillError(f"destination already exists: {to}")
    per_file = edits.groupBy("path").agg(F.collect_list(F.struct("start", "end", "before", "after")).alias("edits"))
    changed = per_file.mapInPandas(_rewrite_files(root), "path string").count()
    at = os.path.join(root, source)
    if target is None:
        if os.path.exists(at):
            os.remove(at)
    elif to != source:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.rename(at, target)
    return changed
