"""The command surface over one vault folder: index, search, similar, links, attrs, doctor, rename, rm, status, version."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import __version__, config
from ..common import cut, stored
from ..errors import NoIndexError, NotemillError, StaleIndexError, UsageError
from ..functions.parser import file_stem, parse_note, parse_notes
from ..functions.snippets import snippet_column
from ..functions.text import analyse, analyse_query
from ..operators import attrs, doctor, index, links, rewrite, search, staleness
from ..sources import vault as source
from . import generation


def as_json(value: Any) -> str:
    """One pretty JSON document."""
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def index_tables(notes: DataFrame, skipped: DataFrame, files: DataFrame, c: config.VaultConfig, stem: bool = True) -> dict[str, DataFrame]:
    """All tables of a generation from `(path, mtime_ms, size, text)`; each note is parsed once.

    Ids are dense and follow the paths: a range partition numbers its rows after the counts of those before,
    so no window gathers all documents in one task.
    """
    parsed = cut(parse_notes(notes, ["path", "mtime_ms", "size"], "path", "text").drop("wiki", "links"))
    n = max(2 * parsed.sparkSession.sparkContext.defaultParallelism, parsed.rdd.getNumPartitions())
    ranged = cut(parsed.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("path")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row per partition
    docs = ranged.withColumn("n", F.row_number().over(w)).join(F.broadcast(starts), "part").withColumn("doc_id", F.col("start") + F.col("n") - 1)
    if c.filterable_frontmatter is not None:
        keep = [k.strip().lower() for k in c.filterable_frontmatter]
        docs = docs.withColumn("attributes", F.map_filter("attributes", lambda k, _: k.isin(keep)))
    docs = cut(docs.drop("part", "n", "start"))
    terms = cut(index.field_terms(docs, stem))
    posted = cut(index.postings(terms, c.field_weights))
    lengths = index.doc_lengths(docs, terms)
    graph = docs.select(F.lit("").alias("vault"), "path", "title", "aliases", "out_links")
    known = cut(links.names(graph))
    linked = cut(links.resolved_links(graph, known))
    shown = F.coalesce(F.try_element_at("attributes", F.lit("tags")), F.array().cast("array<string>"))
    full = cut(docs.drop("body", "tags").join(lengths, "doc_id").withColumn("tags", shown))
    return {
        "docs": full,
        "postings": posted,
        "attrs": index.attributes(docs),
        "corpus_stats": index.corpus_stats(full, posted),
        "skipped": skipped,
        "files": files,
        "names": known,
        "links": linked,
        "backlinks": links.backlinks(linked),
    }


class Vault:
    """Opens the vault at or above `start`; `spark` may be a function that makes the session when it is first needed. Methods return DataFrames, or dictionaries where a command prints one document."""

    def __init__(self, spark: SparkSession | Callable[[], SparkSession], start: str):
        root = config.find_root(start)
        if root is None:
            raise NoIndexError(f"no vault at or above {start}")
        self._session, self.config = spark, config.load(root)
        self.index_root = os.path.join(self.config.home, "index")

    @property
    def spark(self) -> SparkSession:
        if not isinstance(self._session, SparkSession):
            self._session = self._session()
        return self._session

    @staticmethod
    def init(root: str) -> str:
        return config.save(config.VaultConfig(os.path.abspath(root)))

    # -- index -------------------------------------------------------------

    def index(self) -> dict[str, Any]:
        """Build and publish a generation: counts, bytes, elapsed time and the skipped files."""
        began = time.time()
        read = stored(source.read_all(self.spark, self.config))  # once, so all tables are of one moment
        notes, skipped = source.split_read(read)
        files = read.select("path", "mtime_ms", "size")  # skipped files too
        tables = index_tables(notes, skipped, files, self.config)
        generation.publish(self.index_root, tables)
        made = generation.open_index(self.spark, self.index_root)
        s = made["corpus_stats"].first()
        return {
            "docCount": s["doc_count"],
            "termCount": s["term_count"],
            "postingCount": s["posting_count"],
            "indexBytes": generation.size_of(self.index_root),
            "elapsedMs": round((time.time() - began) * 1000),
            "skipped": [r.asDict() for r in made["skipped"].orderBy("path").collect()],
        }

    def tables(self) -> dict[str, DataFrame]:
        return generation.open_index(self.spark, self.index_root)

    def staleness(self) -> dict[str, Any]:
        """Stale where the listing differs from the one at the build; then skipped files count as added."""
        t, now = self.tables(), source.scan(self.spark, self.config)
        whole = staleness.staleness(now, t["files"]).first().asDict()
        if not whole["stale"]:
            return whole
        return staleness.staleness(now, t["files"].join(t["skipped"], "path", "left_anti")).first().asDict()

    def status(self) -> dict[str, Any]:
        """What there is; never fails for want of an index."""
        out: dict[str, Any] = {"root": self.config.root, "config": dict(vars(self.config)), "indexed": False}
        try:
            s = self.tables()["corpus_stats"].first()
            at = os.path.getmtime(os.path.join(self.index_root, generation.POINTER))
            out |= {"indexed": True, "docCount": s["doc_count"], "indexBytes": generation.size_of(self.index_root), "indexedAt": round(at * 1000)}
            out |= self.staleness()
        except NoIndexError as e:
            out["reason"] = str(e)
        return out

    @staticmethod
    def version() -> str:
        return __version__

    # -- queries -----------------------------------------------------------

    def _stats(self, t: dict[str, DataFrame]) -> tuple[float, float]:
        s = t["corpus_stats"].first()
        return s["doc_count"], s["avg_length"]

    def search(self, text: str, filters=(), not_filters=(), tags=(), prefix: str | None = None, limit: str | int = 10, snippets: bool = True) -> DataFrame:
        """`(rank, score, path, title, aliases, tags, matched_terms, snippet)`; records and texts are joined to the hits only."""
        q = search.build_query(analyse_query(text), filters, not_filters, tags, prefix, limit)
        t = self.tables()
        n, avg = self._stats(t)
        hits = search.search(generation.postings_of(t, q.terms), t["docs"], t["attrs"], q, n, avg, self.config.k1, self.config.b)
        return self._shown(hits, t, snippets)

    def _shown(self, hits: DataFrame, t: dict[str, DataFrame], snippets: bool) -> DataFrame:
        hits = cut(hits)
        rows = hits.join(t["docs"].select("doc_id", "title", "aliases", "tags"), "doc_id")
        if snippets:
            paths = [r["path"] for r in hits.select("path").collect()]  # no more than the limit
            texts = [(p, source._read(os.path.join(self.config.root, p))[0]) for p in paths]
            made = parse_notes(self.spark.createDataFrame(texts, "path string, text string"), ["path"], "path", "text").select("path", "body")
            rows = rows.join(made, "path", "left").withColumn("snippet", snippet_column(F.col("body"), F.col("matched_terms")))
        else:
            rows = rows.withColumn("snippet", F.lit(None).cast("string"))
        return rows.select("rank", "score", "path", "title", "aliases", "tags", "matched_terms", "snippet").orderBy("rank")

    def similar(self, argument: str, limit: int = 10, prefix: str | None = None) -> DataFrame:
        t = self.tables()
        path = self.resolve(argument)
        me = t["docs"].where(F.col("path") == path).first()
        text, _ = source._read(os.path.join(self.config.root, path))
        words = self._body_terms(parse_note(text or "", path).body) if text else []
        n, avg = self._stats(t)
        return self._shown(search.similar(words, me["doc_id"], t["postings"], t["docs"], n, avg, limit, prefix), t, False)

    def _body_terms(self, body: str) -> list[str]:
        """Every occurrence, unlike the distinct terms of a query."""
        df = self.spark.createDataFrame([(body,)], "body string")
        return [r["term"] for r in analyse(df, "body").select("term").collect()]

    def _graph(self, *names: str) -> list[DataFrame]:
        """Tables of the index with the vault as a column, which the link operators want."""
        t = self.tables()
        return [t[n].withColumn("vault", F.lit(self.config.root)) for n in names]

    def resolve(self, argument: str) -> str:
        """The path a note argument means; NotemillError where there is none or several."""
        if os.path.isabs(argument):
            argument = os.path.relpath(argument, self.config.root).replace(os.sep, "/")
        notes, known = self._graph("docs", "names")
        name = argument.strip().lower()
        wanted = {name, f"{name}.md", file_stem(name)}  # a filter that reaches the row groups of the sorted names
        asked = self.spark.createDataFrame([(self.config.root, name, 1)], "vault string, name string, n_links long")
        r = links.resolve_names(asked, known.where(F.col("name").isin(list(wanted)))).first()
        if r is None or r["resolved"] is None:
            raise NotemillError(f"no note matches: {argument}")
        if r["candidates"] > 1:
            shown = [x["path"] for x in links.candidates_of(notes, argument).limit(20).collect()]
            raise NotemillError(f"ambiguous: {argument}: {', '.join(shown)}")
        return r["resolved"]

    def links_to(self, argument: str) -> DataFrame:
        path = self.resolve(argument)
        return links.links_to(*self._graph("docs", "backlinks"), self.config.root, path)

    def links_from(self, argument: str) -> DataFrame:
        path = self.resolve(argument)
        return links.links_from(self._graph("links")[0], self.config.root, path)

    def broken(self) -> DataFrame:
        return links.by_target(links.broken_links(self._graph("links")[0])).drop("vault").orderBy("target")

    def attrs(self, limit: int = 0, prefix: str | None = None) -> DataFrame:
        t = self.tables()
        docs = t["docs"].where(F.col("path").startswith(prefix)) if prefix else None
        return attrs.report(attrs.census(t["attrs"], docs), limit)

    def doctor(self, prefix: str | None = None) -> DataFrame:
        notes, linked = self._graph("docs", "links")
        return doctor.report(notes, self.config.split_threshold_words, prefix, linked).drop("vault")

    # -- mutations ---------------------------------------------------------

    def _mutate(self, argument: str, to: str | None, apply: bool, force: bool) -> dict[str, Any]:
        if not force and self.staleness()["stale"]:
            raise StaleIndexError("index is stale; rebuild it or force")
        path = self.resolve(argument)
        if to is not None:
            to = rewrite.normalise_destination(path, to, lambda p: os.path.isdir(os.path.join(self.config.root, p)))
            if to != path and os.path.exists(os.path.join(self.config.root, to)):
                raise NotemillError(f"destination already exists: {to}")
        notes, known, back = self._graph("docs", "names", "backlinks")
        read = cut(source.read_paths(rewrite.referrers(back, self.config.root, path, to), self.config.root))
        gone = read.where("text IS NULL").select("path", F.col("error").alias("reason"))
        texts = read.where("text IS NOT NULL").select(F.lit(self.config.root).alias("vault"), "path", "text")
        parsed = parse_notes(texts, ["vault", "path", "text"], "path", "text")
        edits = cut(rewrite.plan(parsed, notes, self.config.root, path, to, known))
        shown = edits.orderBy("path", "start").select("path", "line", "before", "after").collect()
        out = {
            "from": path,
            "to": to,
            "dryRun": not apply,
            "fileCount": edits.select("path").distinct().count(),
            "edits": [r.asDict() for r in shown],
            "unresolved": {r["path"]: r["reason"] for r in gone.collect()},
        }
        if apply:
            rewrite.apply_to_files(self.config.root, edits, path, to)
        return out

    def rename(self, argument: str, to: str, dry_run: bool = False, force: bool = False) -> dict[str, Any]:
        if not to.strip():
            raise UsageError("a destination is needed")
        return self._mutate(argument, to, not dry_run, force)

    def remove(self, argument: str, dry_run: bool = False, confirmed: bool = False, force: bool = False) -> dict[str, Any]:
        """Without `confirmed` only the plan is made."""
        return self._mutate(argument, None, confirmed and not dry_run, force)
