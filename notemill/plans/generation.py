"""Indexes on disk: Parquet tables in a folder per generation, published by replacing one pointer file."""

from __future__ import annotations

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession

from .. import FORMAT_VERSION
from ..errors import NoIndexError

#: Tables of a generation and what each is sorted by within its files, for pruning by row group.
SORTED = {
    "docs": ["path"], "postings": ["term", "doc_id"], "attrs": ["key", "value", "doc_id"], "corpus_stats": [], "skipped": [], "files": ["path"],
    "names": ["name", "kind"], "links": ["src", "pos"], "backlinks": ["dst", "src"],
}
SCHEMAS = {
    "docs": "doc_id long, path string, title string, aliases array<string>, headings array<string>, out_links array<string>, tags array<string>, length int, word_count int, frontmatter_malformed boolean, frontmatter_links boolean, mtime_ms long, size long",
    "postings": "term string, doc_id long, wtf int",
    "attrs": "doc_id long, key string, value string",
    "corpus_stats": "format_version int, doc_count long, avg_length double, term_count long, posting_count long",
    "skipped": "path string, reason string",
    "files": "path string, mtime_ms long, size long",
    "names": "kind int, name string, first_path string, last_path string, n long",
    "links": "src string, pos int, target string, name string, resolved string, candidates long",
    "backlinks": "dst string, src string",
}
#: Tables written at a time.
WRITERS = 4
POINTER, MANIFEST = "CURRENT", "MANIFEST.json"


def publish(root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables of a new generation, then point to it; readers see the old one or the new one, never a mix.

    The tables are written side by side: small ones take a job's fixed costs, which overlap so.
    """
    gen = f"gen={uuid.uuid4().hex}"

    def write(name: str) -> None:
        df, by = tables[name], SORTED[name]
        df = df.select(*(c.strip().split(" ")[0] for c in _columns(SCHEMAS[name])))
        if by:
            df = df.repartitionByRange(by[0]).sortWithinPartitions(*by)
        df.write.parquet(os.path.join(root, gen, name))

    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(write, tables))
    with open(os.path.join(root, gen, MANIFEST), "w") as f:
        json.dump({"format_version": FORMAT_VERSION, "tables": {name: _sizes(os.path.join(root, gen, name)) for name in tables}}, f)
    draft = os.path.join(root, f".{POINTER}-{uuid.uuid4().hex}")
    with open(draft, "w") as f:
        f.write(gen)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, os.path.join(root, POINTER))
    return gen


def _columns(schema: str) -> list[str]:
    return [c for c in schema.split(", ")]


def current(root: str) -> str:
    try:
        with open(os.path.join(root, POINTER)) as f:
            return os.path.join(root, f.read().strip())
    except OSError as e:
        raise NoIndexError("no index; build one first") from e


def _sizes(folder: str) -> dict[str, int]:
    return {f: os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith(".parquet")}


def validate(at: str) -> None:
    """NoIndexError unless the generation has this format and every table has just the files, of the sizes, that were published."""
    try:
        with open(os.path.join(at, MANIFEST)) as f:
            listed = json.load(f)
        version, tables = listed["format_version"], listed["tables"]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise NoIndexError(f"could not read the index ({type(e).__name__}); rebuild it") from e
    if version != FORMAT_VERSION:
        raise NoIndexError(f"index has format {version}, this reads {FORMAT_VERSION}; rebuild it")
    for name in SCHEMAS:
        try:
            whole = name in tables and _sizes(os.path.join(at, name)) == tables[name]
        except OSError:
            whole = False
        if not whole:
            raise NoIndexError(f"index is damaged: table {name}; rebuild it")


def open_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current generation, with explicit schemas, once it is valid."""
    at = current(root)
    validate(at)
    return {name: spark.read.schema(schema).parquet(os.path.join(at, name)) for name, schema in SCHEMAS.items()}


def postings_of(tables: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """Point read: the filter reaches the row groups of the sorted table."""
    return tables["postings"].where(tables["postings"]["term"].isin(terms))


def document_frequency_of(tables: dict[str, DataFrame], term: str) -> int:
    """In how many documents a term occurs, 0 for an unknown one."""
    return postings_of(tables, [term]).count()


def document_of(tables: dict[str, DataFrame], path: str) -> Row | None:
    """The record of one path, None where there is none."""
    return tables["docs"].where(tables["docs"]["path"] == path).first()


def all_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """Every record, by id."""
    return tables["docs"].orderBy("doc_id")


def size_of(root: str) -> int:
    at = current(root)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)
