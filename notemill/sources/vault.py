"""A folder of notes as a Spark source.

`spark.read.format("notes")` lists and reads a vault through the Python DataSource API: one partition per
top folder group, so that listing and reading are spread over the executors. Symbolic links are not
followed, extensions compare in lower case, excluded folders are not entered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import VaultConfig, load

BOM = "\ufeff"
GONE = "file no longer exists"
SCHEMA = "path string, abs_path string, mtime_ms long, size long, text string, error string"


def glob_pattern(pattern: str) -> str:
    """An anchored regular expression: `*` and `?` within a segment, `**` at any depth, `**/` any number of segments.

    A pattern that ends in `/**` also matches the folder itself.
    """
    folder = pattern.endswith("/**")
    body = pattern[:-3] if folder else pattern
    parts = {"**/": "(?:[^/]*/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    made = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: parts.get(m[0]) or re.sub(r"([^\w/ \-])", r"\\\1", m[0]), body)
    return f"^{made}(?:/.*)?$" if folder else f"^{made}$"


def matches_glob(pattern: str, path: str) -> bool:
    return re.match(glob_pattern(pattern), path) is not None


def _excluded(config: VaultConfig) -> re.Pattern:
    return re.compile("|".join(glob_pattern(p) for p in config.exclude) or r"(?!)")


def walk(config: VaultConfig, folder: str = "", deep: bool = True) -> Iterator[tuple[str, os.stat_result]]:
    """Relative paths of notes below `folder`, with `/`, in no order; unreadable folders and files are passed over."""
    gone, todo = _excluded(config), [folder]
    while todo:
        at = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(config.root, at)))
        except OSError:
            continue
        for e in entries:
            rel = f"{at}/{e.name}" if at else e.name
            if e.is_symlink() or gone.match(rel):
                continue
            if e.is_dir(follow_symlinks=False):
                if deep:
                    todo.append(rel)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in config.extensions:
                try:
                    yield rel, e.stat(follow_symlinks=False)
                except OSError:
                    continue


def _read(path: str) -> tuple[str | None, str | None]:
    """Text without a leading byte order mark, or why there is none: unreadable files and files that are no UTF-8 are skipped with a reason."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8").removeprefix(BOM), None
    except FileNotFoundError:
        return None, GONE
    except UnicodeDecodeError as e:
        return None, f"not valid UTF-8: {e.reason} at byte {e.start}"
    except OSError as e:
        return None, f"cannot read file: {e.strerror}" if e.strerror else "cannot read file"


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, config: VaultConfig, with_text: bool, partitions: int):
        self.config, self.with_text, self.n = config, with_text, partitions

    def partitions(self) -> list[InputPartition]:
        """The driver only looks at the top folders and theirs; the rest is listed by the tasks."""
        gone, jobs, todo = _excluded(self.config), [("", False)], [("", 0)]
        while todo:
            at, depth = todo.pop()
            try:
                inner = [e.name for e in os.scandir(os.path.join(self.config.root, at)) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
            for name in sorted(inner):
                rel = f"{at}/{name}" if at else name
                if gone.match(rel):
                    continue
                jobs.append((rel, depth == 1))
                if depth == 0:
                    todo.append((rel, 1))
        groups: list[list[tuple[str, bool]]] = [[] for _ in range(min(self.n, len(jobs)))]
        for i, j in enumerate(jobs):
            groups[i % len(groups)].append(j)
        return [_Folders(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            for rel, st in walk(self.config, folder, deep):
                at = os.path.join(self.config.root, rel)
                text, error = _read(at) if self.with_text else (None, None)
                yield rel, at, st.st_mtime_ns // 1_000_000, st.st_size, text, error


class NotesSource(DataSource):
    """Options: `path`, the vault's root; `text`, false to list only; `partitions`, 64 unless given."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(load(o["path"]), str(o.get("text", "true")).lower() != "false", int(o.get("partitions", 64)))


def scan(spark: SparkSession, config: VaultConfig) -> DataFrame:
    """`(path, abs_path, mtime_ms, size)` of the vault's notes."""
    spark.dataSource.register(NotesSource)
    return spark.read.format("notes").option("text", "false").load(config.root).drop("text", "error")


def read_notes(spark: SparkSession, config: VaultConfig) -> tuple[DataFrame, DataFrame]:
    """`(path, mtime_ms, size, text)` of readable notes, and `(path, reason)` of skipped ones."""
    return split_read(read_all(spark, config))


def read_all(spark: SparkSession, config: VaultConfig) -> DataFrame:
    """`(path, abs_path, mtime_ms, size, text, error)` of every note, text or error null."""
    spark.dataSource.register(NotesSource)
    return spark.read.format("notes").load(config.root)


def split_read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(path, mtime_ms, size, text)` of what was read, and `(path, reason)` of what was not."""
    return rows.where(F.col("error").isNull()).drop("abs_path", "error"), rows.where(F.col("error").isNotNull()).select("path", F.col("error").alias("reason"))


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """`(path, text, error)` of the files named by column `path`, read by the tasks; nothing else of the vault is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                names = batch.column(0).slice(at, 500)
                got = [_read(os.path.join(root, p)) for p in names.to_pylist()]
                yield pa.RecordBatch.from_arrays([names, pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "text", "error"])

    return paths.select("path").mapInArrow(run, "path string, text string, error string")


def from_table(df: DataFrame, path: str, text: str) -> DataFrame:
    """Any table with a path and a text as notes; null paths and texts are left out."""
    rows = df.where(F.col(path).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(path).alias("path"), F.lit(None).cast("long").alias("mtime_ms"), F.octet_length(text).cast("long").alias("size"), F.col(text).alias("text"))


def manifest_hash(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per group of `by`) with `manifest_hash`: SHA-256 over the sorted lines `path size mtime`.

    The lines of a group come together in one row, which is what the definition asks for; a group is one vault.
    """
    line = F.concat_ws("", "path", F.lit(" "), F.col("size").cast("string"), F.lit(" "), F.col("mtime_ms").cast("string"), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    agg = F.sha2(F.concat_ws("", lines), 256).alias("manifest_hash")
    return files.groupBy(*by).agg(agg) if by else files.agg(agg)
