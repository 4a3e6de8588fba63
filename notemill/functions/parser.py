"""One note's text to its parts: front matter, headings, links, tags, code spans, word count.

A line automaton with exact offsets, which SQL cannot say; it runs in Arrow batches, whole notes at a time.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..common import WHITE, spread


class _Loader(yaml.SafeLoader):
    """YAML 1.2 core scalars, and duplicate keys are errors."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) != len(keys):
            raise yaml.constructor.ConstructorError(None, None, "duplicate key", node.start_mark)
        return super().construct_mapping(node, deep)


_Loader.yaml_implicit_resolvers = {}
for _tag, _regex, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_regex), list(_first))


@dataclass
class Note:
    """Offsets count code points of the body, which begins at `body_at` of the source."""

    title: str = ""
    body: str = ""
    body_at: int = 0
    data: dict[str, Any] = field(default_factory=dict)
    present: bool = False
    malformed: bool = False
    frontmatter_links: bool = False
    aliases: list[str] = field(default_factory=list)
    headings: list[str] = field(default_factory=list)
    wiki: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    inline_tags: list[str] = field(default_factory=list)
    attributes: dict[str, list[str]] = field(default_factory=dict)
    word_count: int = 0


def lines_of(text: str) -> list[tuple[str, int, int]]:
    """`(content, start, end)` of every line; the end is past the line break, and a CR before it is no content."""
    out, start = [], 0
    for raw in text.split("\n"):
        end = min(start + len(raw) + 1, len(text))
        if start < len(text):
            broken = start + len(raw) < len(text)
            out.append((raw[:-1] if broken and raw.endswith("\r") else raw, start, end))
        start = end
    return out


def _scalar(v: Any) -> str | None:
    """A scalar as text: numbers and booleans in lower case; None for anything else."""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float, datetime.date)) else None


def flatten(data: dict[str, Any]) -> dict[str, list[str]]:
    """Keys and values trimmed and lower-cased; a scalar is one value, a list one each; nested and empty ones go."""
    out: dict[str, list[str]] = {}
    for key, v in data.items():
        items = v if isinstance(v, list) else [v]
        if isinstance(v, dict) or any(isinstance(x, (dict, list)) for x in items):
            continue
        values = [s for s in ((_scalar(x) or "").strip(WHITE).lower() for x in items) if s]
        if values and (k := str(key).lower().strip(WHITE)):
            out[k] = values
    return out


def _front(note: Note, source: str) -> None:
    lines = lines_of(source)
    if not lines or lines[0][0] != "---":
        return
    note.present = True
    close = next((i for i, line in enumerate(lines) if i and line[0] in ("---", "...")), None)
    if close is None:
        note.malformed, note.body_at = True, lines[0][2]
        return
    block = "\n".join(line[0] for line in lines[1:close])
    note.body_at, note.frontmatter_links = lines[close][2], "[[" in block
    try:
        doc = yaml.load(block, _Loader)
        note.malformed = not (doc is None or isinstance(doc, dict))
        note.data = {str(k): v for k, v in (doc or {}).items()} if not note.malformed else {}
    except (yaml.YAMLError, ValueError, RecursionError):
        note.malformed = True


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)]) +\S")
_TICKS = re.compile(r"`+")


def code_spans(body: str) -> list[tuple[int, int]]:
    """Sorted ranges of fenced blocks, indented blocks and inline code."""
    lines, blocks, listed, blank, i = lines_of(body), [], False, True, 0
    while i < len(lines):
        content, start, end = lines[i]
        empty, indent = not content.strip(WHITE), len(content) - len(content.lstrip(" "))
        if fence := _FENCE.match(content):
            closing = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*")
            j = next((k for k in range(i + 1, len(lines)) if closing.fullmatch(lines[k][0])), None)
            blocks.append((start, len(body) if j is None else lines[j][2]))
            i, blank = (len(lines) if j is None else j + 1), False
        elif not empty and indent >= 4 and blank and not listed:
            j = i + 1
            while j < len(lines) and (not lines[j][0].strip(WHITE) or lines[j][0].startswith("    ")):
                j += 1
            blocks.append((start, lines[j - 1][2]))
            i, blank = j, False
        else:
            if _ITEM.match(content):
                listed = True
            elif not empty and indent < 4:
                listed = False
            i, blank = i + 1, empty
    spans, at = list(blocks), 0
    for start, end in [*blocks, (len(body), len(body))]:
        runs = [m.span() for m in _TICKS.finditer(body, at, start)]
        k = 0
        while k < len(runs):
            width = runs[k][1] - runs[k][0]
            match = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == width), None)
            if match is not None:
                spans.append((runs[k][0], runs[match][1]))
                k = match
            k += 1
        at = end
    return sorted(spans)


_ATX = re.compile(r" {0,3}(#{1,6})(?:\s+(.*))?")
_CLOSING = re.compile(r"\s+#+\s*$")
_WIKI = re.compile(r"(!)?\[\[([^\[\]]*)\]\]")
_LINK = re.compile(r"(!)?\[([^\[\]]*)\]\(([^()]*)\)")
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*:")
_TAG = re.compile(r"(?<!\S)#(?![ \t])([A-Za-z0-9_/\-]+)")


def _wiki(m: re.Match) -> dict:
    bare, bar, alias = m[2].partition("|")
    parts = re.split(r"[#^]", bare, maxsplit=1)
    return {
        "target": parts[0],
        "anchor": parts[1] if len(parts) > 1 else None,
        "alias": alias if bar else None,
        "embed": bool(m[1]),
        "start": m.start(),
        "end": m.end(),
    }


def _target(inside: str) -> tuple[int, int] | None:
    """Range of the raw target in a link's brackets, without blanks, an optional title and angle brackets."""
    m = re.fullmatch(r"(\s*)(.*?)\s*", inside, re.S)
    start, raw = len(m[1]), m[2]
    if titled := re.fullmatch(r"(\S+)\s+[\"'].*", raw, re.S):
        raw = titled[1]
    if len(raw) > 1 and raw[0] == "<" and raw[-1] == ">":
        start, raw = start + 1, raw[1:-1]
    return (start, start + len(raw)) if raw else None


def _link(m: re.Match) -> dict | None:
    found = None if m[1] else _target(m[3])
    if not found:
        return None
    raw = m[3][found[0] : found[1]]
    if _SCHEME.match(raw) or raw.startswith(("//", "#")):
        return None
    target = raw
    if not re.search(r"%(?![0-9A-Fa-f]{2})", raw):
        try:
            target = unquote_to_bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            pass
    name = target.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    if dot > 0 and name[dot:].lower() not in (".md", ".markdown"):
        return None
    at = m.start(3)
    return {"target": target, "text": m[2], "start": m.start(), "end": m.end(), "target_start": at + found[0], "target_end": at + found[1]}


def _lookup(data: dict[str, Any], key: str) -> Any:
    return next((v for k, v in data.items() if k.lower() == key), None)


def file_stem(path: str) -> str:
    """The last segment without its extension; a leading dot begins no extension."""
    name = path.rsplit("/", 1)[-1]
    return name[: name.rfind(".")] if name.rfind(".") > 0 else name


def parse_note(source: str, filename: str) -> Note:
    """Everything the index and the link graph need of one note."""
    note = Note()
    _front(note, source)
    body = note.body = source[note.body_at :]
    spans = code_spans(body)

    def outside(at: int) -> bool:
        return not any(a <= at < b for a, b in spans)

    first = None
    for content, start, _ in lines_of(body):
        if (m := _ATX.fullmatch(content)) and outside(start):
            text = _CLOSING.sub("", (m[2] or "").strip(WHITE)).strip(WHITE)
            note.headings.append(text)
            if first is None and len(m[1]) == 1:
                first = text
    note.wiki = [_wiki(m) for m in _WIKI.finditer(body) if outside(m.start())]
    note.links = [x for m in _LINK.finditer(body) if outside(m.start()) and (x := _link(m))]
    note.inline_tags = [m[1].lower() for m in _TAG.finditer(body) if outside(m.start()) and not m[1].isdigit()]
    named = (_scalar(_lookup(note.data, "title")) or "").strip(WHITE)
    note.title = named or first or file_stem(filename)
    raw = _lookup(note.data, "aliases")
    raw = _lookup(note.data, "alias") if raw is None else raw
    listed = raw if isinstance(raw, list) else [] if raw is None else [raw]
    shown = ["null" if x is None else _scalar(x) if _scalar(x) is not None else str(x) for x in listed]
    note.aliases = [s for s in shown if s.strip(WHITE)]
    note.word_count = len(re.findall(f"[^{WHITE}]+", body))
    note.attributes = flatten(note.data)
    tags = sorted({*note.attributes.get("tags", []), *note.inline_tags})
    if tags:
        note.attributes["tags"] = tags
    return note


_WIKI_T = "array<struct<target:string,anchor:string,alias:string,embed:boolean,start:int,end:int>>"
_LINK_T = "array<struct<target:string,text:string,start:int,end:int,target_start:int,target_end:int>>"
#: What `parse_notes` adds to the columns that name a note.
PARSED = (
    "title string, aliases array<string>, headings array<string>, out_links array<string>, tags array<string>, word_count int, "
    "frontmatter_present boolean, frontmatter_malformed boolean, frontmatter_links boolean, "
    f"attributes map<string,array<string>>, body string, body_at int, wiki {_WIKI_T}, links {_LINK_T}"
)


def _row(source: str, filename: str) -> dict:
    n = parse_note(source, filename)
    return {
        "title": n.title,
        "aliases": n.aliases,
        "headings": n.headings,
        "out_links": [x["target"] for x in [*n.wiki, *n.links]],
        "tags": list(dict.fromkeys([*n.attributes.get("tags", []), *n.attributes.get("tag", []), *n.inline_tags])),
        "word_count": n.word_count,
        "frontmatter_present": n.present,
        "frontmatter_malformed": n.malformed,
        "frontmatter_links": n.frontmatter_links,
        "attributes": list(n.attributes.items()),
        "body": n.body,
        "body_at": n.body_at,
        "wiki": n.wiki,
        "links": n.links,
    }


def parse_notes(df: DataFrame, keys: list[str], filename: str, text: str) -> DataFrame:
    """`keys` and the columns of PARSED, one row per row of `df`; null texts parse as empty ones."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, {PARSED}"
    made = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [_row(t or "", f or "") for t, f in zip(part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist())]
                cols = [pa.array([r[f.name] for r in rows], f.type) for f in made]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + cols, names=[*keys, *made.names])

    return spread(df.select(*keys, F.col(text).alias("__text"), F.col(filename).alias("__name"))).mapInArrow(run, schema)
