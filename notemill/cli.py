"""The command line: eleven commands over one vault; with --json one JSON document on standard output.

Results go to standard output, warnings and errors to standard error. Exit codes: 0 done, 1 not found, ambiguous or
refused, 2 wrong usage, 3 no vault, no usable index, or an index too old for a change.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import NotemillError, UsageError
from .functions.text import analyse_query
from .plans.vault import Vault, as_json

#: Values of a key that `attrs` shows unless told otherwise.
VALUES_SHOWN = 12


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(f"{message}\n\n{self.format_usage()}")


def parser() -> argparse.ArgumentParser:
    shared = _Parser(add_help=False, argument_default=argparse.SUPPRESS)
    shared.add_argument("--vault", metavar="FOLDER", help="the vault's root; by default searched from the current folder up")
    shared.add_argument("--json", action="store_true", help="one JSON document instead of text")
    shared.add_argument("--quiet", action="store_true", help="no warnings")
    top = _Parser(prog="notemill", parents=[shared])
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def command(name: str, about: str, *args: tuple) -> None:
        p = commands.add_parser(name, help=about, parents=[shared])
        for flags, options in args:
            p.add_argument(*flags, **options)

    opt = lambda *flags, **options: (flags, options)
    limit = opt("-n", "--limit")
    prefix = opt("--path-prefix")
    dry, force = opt("--dry-run", action="store_true"), opt("--force", action="store_true")
    command("init", "make a folder a vault", opt("folder", nargs="?"))
    command("index", "build and publish the index", opt("--stats", action="store_true"))
    command("status", "what there is")
    command(
        "search", "ranked search", opt("query", nargs="+"), limit, opt("--filter", action="append", default=[]), opt("--not", dest="without", action="append", default=[]),
        opt("--tag", action="append", default=[]), prefix, opt("--snippets", action=argparse.BooleanOptionalAction, default=True),
    )
    command("similar", "notes like one note", opt("note"), limit, prefix)
    command("links", "links to or from a note, or all broken ones", opt("--to"), opt("--from", dest="source"), opt("--broken", action="store_true"))
    command("attrs", "the attribute vocabulary", opt("--key"), limit, prefix)
    command("doctor", "what is wrong with the vault", prefix)
    command("rename", "move a note and rewrite the links to it", opt("note"), opt("to"), dry, force)
    command("rm", "delete a note and rewrite the links to it", opt("note"), dry, opt("--yes", action="store_true"), force)
    command("version", "the version")
    return top


def _number(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None else default
    except ValueError:
        return default


class _Run:
    """One invocation: the vault is opened, and Spark started, when a command first needs it."""

    def __init__(self, args: argparse.Namespace, out: TextIO, err: TextIO, spark: Callable[[], SparkSession], ask: Callable[[str], str]):
        self.args, self.out, self.err, self._spark, self.ask = args, out, err, spark, ask
        self.quiet, self.json = getattr(args, "quiet", False), getattr(args, "json", False)
        self.opened: Vault | None = None

    @property
    def vault(self) -> Vault:
        if self.opened is None:
            self.opened = Vault(self._spark, getattr(self.args, "vault", None) or os.getcwd())
        return self.opened

    def warn(self, text: str) -> None:
        if not self.quiet:
            print(text, file=self.err)

    def emit(self, body: dict[str, Any], lines: list[str]) -> int:
        print(as_json(body) if self.json else "\n".join(lines), file=self.out)
        return 0

    def stale(self) -> dict[str, Any]:
        s = self.vault.staleness()
        if s["stale"]:
            self.warn(f"index is stale ({s['added']} added, {s['changed']} changed, {s['removed']} removed); rebuild it")
        return s if s["stale"] else {"stale": False}

    def hits(self, df, body: dict[str, Any]) -> int:
        rows = [
            {"rank": r["rank"], "score": r["score"], "path": r["path"], "title": r["title"], "aliases": r["aliases"], "tags": r["tags"], "matchedTerms": r["matched_terms"], "snippet": r["snippet"]}
            for r in df.collect()
        ]
        lines = [f"{h['rank']}. {h['title']} ({h['path']}) {h['score']:.3f}" + (f"\n   {h['snippet']}" if h["snippet"] else "") for h in rows]
        return self.emit(body | {"hits": rows}, lines or ["no results"])

    def init(self) -> int:
        at = Vault.init(self.args.folder or getattr(self.args, "vault", None) or os.getcwd())
        return self.emit({"config": at}, [at])

    def index(self) -> int:
        s = self.vault.index()
        for x in s["skipped"]:
            self.warn(f"skipped {x['path']}: {x['reason']}")
        lines = [f"indexed {s['docCount']} notes in {s['elapsedMs']} ms"]
        return self.emit(s, lines + ([f"{s['termCount']} terms, {s['postingCount']} postings, {s['indexBytes']} bytes"] if self.args.stats else []))

    def status(self) -> int:
        s, c = self.vault.status(), self.vault.config
        shown = {"k1": c.k1, "b": c.b, "splitThresholdWords": c.split_threshold_words, "exclude": list(c.exclude), "extensions": list(c.extensions)}
        body: dict[str, Any] = {"vaultRoot": s["root"], "indexPresent": s["indexed"], "config": shown}
        if s["indexed"]:
            at = dt.datetime.fromtimestamp(s["indexedAt"] / 1000, dt.timezone.utc)
            body |= {"docCount": s["docCount"], "indexBytes": s["indexBytes"], "indexMtime": at.isoformat(timespec="milliseconds")}
            body |= {k: s[k] for k in ("stale", "added", "changed", "removed")}
        return self.emit(body, [f"{k}: {v}" for k, v in body.items() if k != "config"])

    def search(self) -> int:
        a, text = self.args, " ".join(self.args.query)
        terms, v = analyse_query(text), self.vault
        stale = self.stale()
        if not terms and text.strip():
            self.warn(f'nothing to match on: every word in "{text}" is a stop word or too short')
        hits = v.search(text, a.filter, a.without, a.tag, a.path_prefix, _number(a.limit, 10), a.snippets)
        return self.hits(hits, {"query": text, "terms": terms} | stale)

    def similar(self) -> int:
        stale, path = self.stale(), self.vault.resolve(self.args.note)
        return self.hits(self.vault.similar(path, _number(self.args.limit, 10), self.args.path_prefix), {"note": path} | stale)

    def links(self) -> int:
        a = self.args
        if (a.to is not None) + (a.source is not None) + a.broken != 1:
            raise UsageError("give just one of --to, --from and --broken")
        stale = self.stale()
        if a.to is not None:
            path = self.vault.resolve(a.to)
            rows = [r.asDict() for r in self.vault.links_to(path).collect()]
            return self.emit({"to": path} | stale | {"backlinks": rows}, [f"{r['path']}  {r['title']}" for r in rows])
        if a.source is not None:
            path = self.vault.resolve(a.source)
            rows = [r.asDict() for r in self.vault.links_from(path).collect()]
            return self.emit({"from": path} | stale | {"links": rows}, [f"{r['target']} -> {r['resolvedPath'] or 'nothing'}" for r in rows])
        rows = [r.asDict() for r in self.vault.broken().collect()]
        return self.emit(stale | {"broken": rows}, [f"{r['target']}: {', '.join(r['referrers'])}" for r in rows])

    def attrs(self) -> int:
        a, stale, t = self.args, self.stale(), self.vault.tables()
        key = a.key.strip().lower() if a.key is not None else None
        limit = _number(a.limit, VALUES_SHOWN) if a.limit is not None or key is None else 0
        report = self.vault.attrs(limit, a.path_prefix)
        report = report.where(F.col("key") == key) if key is not None else report
        keys = [
            {"key": r["key"], "occurrences": r["occurrences"], "distinctValues": r["distinct_values"], "truncated": r["truncated"], "values": [{"value": x["value"], "notes": x["doc_count"]} for x in r["values"]]}
            for r in report.collect()
        ]
        docs = t["docs"].where(F.col("path").startswith(a.path_prefix)) if a.path_prefix else t["docs"]
        body = {"docCount": docs.count()} | ({"pathPrefix": a.path_prefix} if a.path_prefix is not None else {}) | stale | {"keys": keys}
        return self.emit(body, [f"{k['key']} ({k['occurrences']}): " + ", ".join(f"{x['value']} {x['notes']}" for x in k["values"]) for k in keys])

    def doctor(self) -> int:
        stale, prefix = self.stale(), self.args.path_prefix
        found: dict[str, list] = {k: [] for k in ("brokenLinks", "oversized", "duplicateTitles", "ambiguousLinks", "orphans", "malformedFrontmatter", "frontmatterLinks")}
        several: dict[tuple[str, str], list[str]] = {}
        for r in self.vault.doctor(prefix).orderBy("finding", "name", "path").collect():
            kind = r["finding"]
            if kind == "oversized":
                found[kind].append({"path": r["path"], "wordCount": int(r["name"])})
            elif kind in ("brokenLinks", "ambiguousLinks", "duplicateTitles"):
                several.setdefault((kind, r["name"]), []).append(r["path"])
            else:
                found[kind].append(r["path"])
        found["oversized"].sort(key=lambda x: (-x["wordCount"], x["path"]))
        for (kind, name), paths in several.items():
            found[kind].append({"name": name, "paths": paths} if kind == "duplicateTitles" else {"target": name, "referrers": paths})
        return self.emit(stale | ({"pathPrefix": prefix} if prefix is not None else {}) | found, [f"{k}: {len(v)}" for k, v in found.items()])

    def _changed(self, plan: dict[str, Any], action: str) -> list[str]:
        edits = [f"{e['path']}:{e['line']}  {e['before']} -> {e['after']}" for e in plan["edits"]]
        return [f"{action} {plan['from']}" + (f" to {plan['to']}" if plan["to"] else ""), *edits, *(f"{p}: {why}" for p, why in plan["unresolved"].items())]

    def rename(self) -> int:
        a = self.args
        plan = self.vault.rename(a.note, a.to, a.dry_run, a.force)
        if not a.dry_run:
            self.warn("index is now stale; rebuild it")
        return self.emit(plan, self._changed(plan, "would rename" if a.dry_run else "renamed"))

    def rm(self) -> int:
        a = self.args
        yes = a.yes
        if not a.dry_run and not yes:
            path = self.vault.resolve(a.note)
            try:
                yes = self.ask(f"delete {path} and rewrite the links to it? [y/N] ").strip().lower() in ("y", "yes")
            except EOFError:
                yes = False
            if not yes:
                raise NotemillError("aborted")
        plan = self.vault.remove(a.note, a.dry_run, yes, a.force)
        if not a.dry_run:
            self.warn("index is now stale; rebuild it")
        return self.emit(plan, self._changed(plan, "would delete" if a.dry_run else "deleted"))

    def version(self) -> int:
        return self.emit({"version": Vault.version()}, [Vault.version()])


def _session() -> SparkSession:
    s = SparkSession.builder.appName("notemill").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv: list[str] | None = None, out: TextIO | None = None, err: TextIO | None = None, spark: SparkSession | None = None, ask: Callable[[str], str] = input) -> int:
    """Run one command and return its exit code."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = parser().parse_args(sys.argv[1:] if argv is None else argv)
        return getattr(_Run(args, out, err, spark or _session, ask), args.command)()
    except NotemillError as e:
        print(e, file=err)
        return e.exit_code
    except SystemExit as e:  # --help
        return int(e.code or 0)
