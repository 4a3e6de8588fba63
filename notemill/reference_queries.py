"""Queries of the retrieval and link-graph operators over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spread, stored, table
from .functions.parser import parse_notes
from .functions.snippets import snippet_column
from .functions.stemmer import stem_column
from .functions.text import STOPWORDS, tokens
from .operators import attrs, doctor, index, links, rewrite, search, snapshots, staleness
from .sources.vault import manifest_hash
from .sqltext import sql_norm, sql_trim

Query = Callable[[SparkSession, str], DataFrame]
TERMS = ["queue", "fanting", "nompum", "explains", "notaterm"]


def _on(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


# -- Spark ---------------------------------------------------------------------


def _posted(notes: DataFrame) -> DataFrame:
    return index.postings(index.indexed_terms(notes))


def _lengths(notes: DataFrame) -> DataFrame:
    return index.doc_lengths(notes.select(F.col("note_id").alias("doc_id")), index.indexed_terms(notes))


def _stats(notes: DataFrame) -> tuple[int, float]:
    s = _lengths(notes).agg(F.count(F.lit(1)), F.sum("length")).first()
    return s[0], (s[1] or 0) / max(s[0], 1)


def _search(notes: DataFrame, q: search.SearchQuery) -> DataFrame:
    docs = search.searchable_documents(notes, _lengths(notes))
    hits = search.search(_posted(notes), docs, index.attributes(notes, "note_id"), q, *_stats(notes))
    return hits.select("rank", "doc_id", "path", "score", F.concat_ws(" ", "matched_terms").alias("matched_terms"))


def _census(notes: DataFrame, prefix: str | None = None) -> DataFrame:
    docs = notes.where(F.col("path").startswith(prefix)).select(F.col("note_id").alias("doc_id")) if prefix else None
    return attrs.census(index.attributes(notes, "note_id"), docs)


def _attr_report(notes: DataFrame) -> DataFrame:
    r = attrs.report(_census(notes), 5)
    shown = F.concat_ws("|", F.transform("values", lambda v: F.concat(v["value"], F.lit(":"), v["doc_count"].cast("string"))))
    return r.select("key", "occurrences", "distinct_values", "truncated", shown.alias("shown"))


def _indexed(notes: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
    """Postings by note, document frequencies, the number of notes and their mean length."""
    made = stored(index.document_postings(notes))
    s = made.agg(F.count(F.lit(1)), F.sum("length")).first()
    return made, index.document_frequency(made.select(F.explode("terms").alias("term"))), s[0], (s[1] or 0) / max(s[0], 1)


def _batch(notes: DataFrame) -> DataFrame:
    """Every note whose id is divisible by 20 asks with its title, against all notes."""
    return search.search_batch(search.title_terms(notes.where(F.col("note_id") % 20 == 0)), *_indexed(notes))


def _similar(notes: DataFrame) -> DataFrame:
    """The ten notes most like each note whose id is divisible by 20, by its own best body terms, against all notes."""
    made, df, n, avg = _indexed(notes)
    body = index.indexed_terms(notes.where(F.col("note_id") % 20 == 0)).where(F.col("field") == "body")
    queries = search.query_terms(body.select(F.col("doc_id").alias("query_id"), "term"), df, n)
    return search.search_batch(queries, made, df, n, avg, exclude_self=True)


def _latest(files: DataFrame, snap: str) -> DataFrame:
    held = files.where(F.col("snap") == snap).groupBy("vault", "path").agg(F.max_by(F.struct("mtime_ms", "size"), "loaded_at").alias("v"))
    return held.select("vault", "path", "v.mtime_ms", "v.size")


def _staleness(files: DataFrame) -> DataFrame:
    return staleness.staleness(_latest(files, "2025-06"), _latest(files, "2025-05"), ["vault"], ["vault", "path"])


def _held(files: DataFrame) -> DataFrame:
    """`(vault, snap, path, mtime_ms, size)` of all snapshots: of several rows with one key the latest loaded; a null loaded_at is the earliest."""
    loaded = F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**63)))
    held = files.groupBy("vault", "snap", "path").agg(F.max_by(F.struct("mtime_ms", "size"), loaded).alias("v"))
    return held.select("vault", "snap", "path", "v.mtime_ms", "v.size")


def _staleness_snaps(files: DataFrame) -> DataFrame:
    """Every snapshot of every vault against the one before it that the vault has, the first against none."""
    held = _held(files)
    later = snapshots.snapshot_order(files).where("next_snap IS NOT NULL").select("vault", "snap", "next_snap")
    before = held.join(later, ["vault", "snap"]).select("vault", F.col("next_snap").alias("snap"), "path", "mtime_ms", "size")
    return staleness.staleness(held, before, ["vault", "snap"], ["vault", "snap", "path"])


def _manifest_hash_snaps(files: DataFrame) -> DataFrame:
    return manifest_hash(_held(files).where("size IS NOT NULL"), ["vault", "snap"])


#: What a link of the tables cannot contain to be written as one.
UNWRITABLE = r"[\[\]\n]"
#: What a Markdown link cannot contain besides; such links are written between double brackets.
NO_MARKDOWN = r"[()<>%\"'\s]"


def _rendered(notes: DataFrame) -> DataFrame:
    """Notes as files: front matter, a title line, each link on a line of its own, and one in code that must not count.

    Links take turns: plain, with a heading and shown text, as an embedded block, as a Markdown link.
    """
    link = F.transform(
        F.coalesce("out_links", F.array().cast("array<string>")),
        lambda x, i: F.when(
            x.isNotNull() & ~x.rlike(UNWRITABLE),
            F.concat(
                F.lit("- "),
                F.when(i % 4 == 1, F.concat(F.lit("[["), x, F.lit("#Top|shown]]")))
                .when(i % 4 == 2, F.concat(F.lit("![["), x, F.lit("^b1]]")))
                .when((i % 4 == 3) & ~x.rlike(NO_MARKDOWN), F.concat(F.lit("[label]("), x, F.lit(' "title")')))
                .otherwise(F.concat(F.lit("[["), x, F.lit("]]"))),
                F.lit("\n"),
            ),
        ),
    )
    head = F.concat(F.lit("---\nstatus: draft\n---\n# "), F.coalesce("title", F.lit("")), F.lit("\n"))
    text = F.concat(head, F.concat_ws("", link), F.lit("`[[code]]`\n"))
    return notes.select("note_id", "vault", "path", "title", "aliases", "out_links", text.alias("text"))


def _most_linked(notes: DataFrame) -> tuple[str, str]:
    back = links.backlinks(links.resolved_links(notes))
    r = back.groupBy("vault", "dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "vault", "dst").first()
    return (r["vault"], r["dst"]) if r else ("", "")


def _plan(notes: DataFrame, to: str | None) -> DataFrame:
    vault, path = _most_linked(notes)
    parsed = parse_notes(_rendered(notes.where(F.col("vault") == vault)), ["vault", "path", "text"], "path", "text")
    return rewrite.plan(parsed, notes, vault, path, to).select("path", "line", "before", "after")


def _parsed_links(notes: DataFrame) -> DataFrame:
    """Targets that the parser finds in notes rendered as files, in document order."""
    parsed = parse_notes(_rendered(notes), ["note_id", "path"], "path", "text")
    return parsed.select("note_id", F.posexplode("out_links").alias("pos", "target"))


def _parsed_documents(documents: DataFrame) -> DataFrame:
    p = parse_notes(documents, ["doc_id"], "filename", "text")
    return p.select(
        "doc_id", "title", F.size("headings").alias("n_headings"), F.size("out_links").alias("n_links"), F.size("tags").alias("n_tags"),
        "word_count", "frontmatter_present", "frontmatter_malformed", "frontmatter_links", F.map_keys("attributes").alias("attribute_keys"),
    )


def _tokens(documents: DataFrame) -> DataFrame:
    rows = spread(documents.select("doc_id", "text")).select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def _stems(documents: DataFrame) -> DataFrame:
    return stem_column(_tokens(documents), "token").groupBy("token").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _document_search(documents: DataFrame) -> DataFrame:
    """From raw texts to a ranked list with snippets: parse, analyse, index, search."""
    parsed = cut(parse_notes(documents, ["doc_id"], "filename", "text").drop("wiki", "links"))
    parsed = parsed.withColumn("path", F.concat(F.lit("documents/"), F.col("doc_id").cast("string")))
    terms = cut(index.field_terms(parsed))
    posted, lengths = index.postings(terms), index.doc_lengths(parsed, terms)
    s = lengths.agg(F.count(F.lit(1)), F.sum("length")).first()
    docs = parsed.select("doc_id", "path").join(lengths, "doc_id")
    q = search.SearchQuery(["latenc", "checksum", "kiln"], limit=20)
    hits = search.search(posted, docs, None, q, s[0], (s[1] or 0) / max(s[0], 1))
    rows = hits.join(parsed.select("doc_id", "title", "body"), "doc_id")
    return rows.select("rank", "doc_id", "path", "score", "title", snippet_column(F.col("body"), F.col("matched_terms")).alias("snippet"))


# -- SQL -----------------------------------------------------------------------


def sql_file_stem(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


_OCC = f"""
occ AS (
  SELECT note_id AS doc_id, {sql_norm("t.term")} AS term, t.field AS field FROM (SELECT note_id, unnest(terms) AS t FROM notes) WHERE t.term IS NOT NULL),
posted AS (
  SELECT term, doc_id,
    greatest(1, round(sum(CASE field WHEN 'title' THEN 3.0 WHEN 'alias' THEN 3.0 WHEN 'heading' THEN 2.0 WHEN 'tag' THEN 2.0 ELSE 1.0 END)))::INT AS wtf
  FROM occ GROUP BY term, doc_id),
lens AS (
  SELECT note_id AS doc_id, coalesce(n, 0)::INT AS length FROM notes LEFT JOIN (SELECT doc_id, count(*) AS n FROM occ GROUP BY doc_id) o ON o.doc_id = note_id),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
st AS (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS av FROM lens),
attr AS (
  SELECT DISTINCT note_id AS doc_id, {sql_norm("k")} AS key, {sql_norm("v")} AS value
  FROM (SELECT note_id, k, unnest(attributes[k]) AS v FROM (SELECT note_id, attributes, unnest(map_keys(attributes)) AS k FROM notes))
  WHERE {sql_trim("v")} <> '' AND {sql_trim("k")} <> '')"""
_SHARE = """ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * wtf * 2.2::DOUBLE
  / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / av))"""


def _sql_search(where: str, limit: int) -> str:
    listed = ", ".join(f"'{t}'" for t in TERMS)
    return f"""
WITH {_OCC},
hit AS (
  SELECT p.doc_id, notes.path, p.term, list_position([{listed}], p.term) AS pos, {_SHARE} AS s
  FROM posted p JOIN df USING (term) JOIN lens USING (doc_id) JOIN notes ON note_id = p.doc_id, st
  WHERE p.term IN ({listed}) AND {where}),
scored AS (
  SELECT doc_id, path, round(sum(s ORDER BY pos), 9) AS score, string_agg(term, ' ' ORDER BY pos) AS matched_terms FROM hit GROUP BY doc_id, path)
SELECT row_number() OVER (ORDER BY score DESC, path, doc_id)::INT AS rank, * FROM scored ORDER BY rank LIMIT {limit}"""


def _has(key: str, *values: str) -> str:
    return f"p.doc_id IN (SELECT doc_id FROM attr WHERE key = '{key}' AND value IN ({', '.join(repr(v) for v in values)}))"


def _sql_batch(queries: str, extra: str) -> str:
    return f"""
WITH {_OCC},
{queries},
sums AS (
  SELECT q.query_id, p.doc_id, round(sum({_SHARE}), 8) AS score
  FROM q JOIN posted p USING (term) JOIN df USING (term) JOIN lens ON lens.doc_id = p.doc_id, st {extra} GROUP BY q.query_id, p.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, doc_id)::INT AS rank, doc_id, path, score
FROM sums JOIN notes ON note_id = doc_id QUALIFY rank <= 10"""


_Q_TITLES = f"""q AS (
  SELECT DISTINCT note_id AS query_id, {sql_norm("t.term")} AS term FROM (SELECT note_id, unnest(terms) AS t FROM notes WHERE note_id % 20 = 0)
  WHERE t.field = 'title' AND t.term IS NOT NULL)"""
_Q_BODY = """tf AS (SELECT doc_id AS query_id, term, count(*) AS tf FROM occ WHERE field = 'body' AND doc_id % 20 = 0 GROUP BY ALL),
q AS (
  SELECT query_id, term FROM tf JOIN df USING (term), st
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(tf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 9) DESC, term) <= 20)"""

_LINKS = f"""
n AS (
  SELECT vault, path, {sql_norm("path")} AS np, {sql_norm(sql_file_stem("path"))} AS ns, {sql_norm("title")} AS nt,
         list_transform(aliases, lambda a: {sql_norm("a")}) AS na FROM notes),
by_path AS (SELECT vault, np AS name, max(path) AS path FROM n GROUP BY ALL),
by_stem AS (SELECT vault, ns AS name, min(path) AS path, count(*) AS c FROM n GROUP BY vault, ns),
by_title AS (SELECT vault, nt AS name, min(path) AS path, count(*) AS c FROM n WHERE nt <> '' GROUP BY vault, nt),
by_alias AS (SELECT vault, name, min(path) AS path, count(*) AS c FROM (SELECT vault, path, unnest(na) AS name FROM n) WHERE name <> '' GROUP BY vault, name),
o AS (
  SELECT vault, path AS src, (i - 1)::INT AS pos, out_links[i] AS target, {sql_norm("out_links[i]")} AS name
  FROM (SELECT vault, path, out_links, unnest(range(1, len(out_links) + 1)) AS i FROM notes) WHERE out_links[i] IS NOT NULL),
r AS (
  SELECT o.vault, o.src, o.pos, o.target, o.name,
    CASE WHEN o.name <> '' THEN coalesce(p.path, m.path, s.path, t.path, a.path) END AS resolved,
    CASE WHEN o.name = '' THEN 0 WHEN p.path IS NOT NULL OR m.path IS NOT NULL THEN 1 ELSE coalesce(s.c, t.c, a.c, 0) END AS candidates
  FROM o LEFT JOIN by_path p ON p.vault = o.vault AND p.name = o.name
  LEFT JOIN by_path m ON m.vault = o.vault AND m.name = o.name || '.md' AND NOT ends_with(o.name, '.md')
  LEFT JOIN by_stem s ON s.vault = o.vault AND s.name = {sql_file_stem("o.name")}
  LEFT JOIN by_title t ON t.vault = o.vault AND t.name = o.name
  LEFT JOIN by_alias a ON a.vault = o.vault AND a.name = o.name),
broken AS (SELECT DISTINCT vault, {sql_trim("target")} AS target, src AS referrer FROM r WHERE resolved IS NULL AND name <> ''),
ambiguous AS (SELECT DISTINCT vault, target, src AS referrer FROM r WHERE candidates > 1),
back AS (SELECT DISTINCT vault, resolved AS dst, src FROM r WHERE resolved IS NOT NULL),
unlinked AS (
  SELECT vault, path FROM notes WHERE coalesce(len(out_links), 0) = 0
  EXCEPT SELECT vault, dst FROM back),
spoken AS (SELECT DISTINCT vault, path, unnest(list_append(coalesce(na, []), nt)) AS name FROM n),
collide AS (
  SELECT vault, name, path FROM spoken WHERE name <> ''
  QUALIFY count(*) OVER (PARTITION BY vault, name) > 1)"""

_SPLIT = r"\1 \2"
_RUN = "run"
for _pattern, _times in ((r"([^\p{Lu}\p{N} ])(\p{Lu})", 1), (r"(\p{N})([^\p{N} ])", 1), (r"([^\p{N} ])(\p{N})", 1), (r"(\p{Lu})(\p{Lu}\p{Ll})", 1)):
    _RUN = f"regexp_replace({_RUN}, '{_pattern}', '{_SPLIT}', 'g')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = rf"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+')) AS run FROM documents),
parts AS (SELECT doc_id, run, string_split({_RUN}, ' ') AS parts FROM runs),
words AS (
  SELECT doc_id, lower(run) AS token FROM parts
  UNION ALL SELECT doc_id, lower(unnest(parts)) FROM parts WHERE len(parts) > 1)
SELECT doc_id, token, count(*) AS n FROM words WHERE length(token) >= 2 AND token NOT IN ({_STOP}) GROUP BY doc_id, token"""

_SNAP = """(SELECT vault, path, mtime_ms, size FROM files WHERE snap = '{0}'
  QUALIFY row_number() OVER (PARTITION BY vault, path ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_STALE = f"""
WITH d AS (
  SELECT coalesce(a.vault, b.vault) AS vault,
    CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
         WHEN a.mtime_ms IS DISTINCT FROM b.mtime_ms OR a.size IS DISTINCT FROM b.size THEN 'changed' END AS state
  FROM {_SNAP.format("2025-06")} a FULL JOIN {_SNAP.format("2025-05")} b ON a.vault = b.vault AND a.path = b.path)
SELECT vault, true AS stale, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed,
  count(*) FILTER (state = 'removed') AS removed FROM d WHERE state IS NOT NULL GROUP BY vault"""
_MANIFEST = f"""
SELECT vault, sha256(string_agg(path || ' ' || coalesce(size::VARCHAR, '') || ' ' || mtime_ms::VARCHAR || chr(10), '' ORDER BY path)) AS manifest_hash
FROM {_SNAP.format("2025-06")} WHERE size IS NOT NULL GROUP BY vault"""

_HELD = """held AS (
  SELECT vault, snap, path, mtime_ms, size FROM files
  QUALIFY row_number() OVER (PARTITION BY vault, snap, path ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_STALE_SNAPS = f"""
WITH {_HELD},
own AS (SELECT vault, snap, lag(snap) OVER (PARTITION BY vault ORDER BY snap) AS prior FROM (SELECT DISTINCT vault, snap FROM files)),
b AS (SELECT own.vault, own.snap, path, mtime_ms, size FROM own JOIN held ON held.vault = own.vault AND held.snap = own.prior),
d AS (
  SELECT coalesce(a.vault, b.vault) AS vault, coalesce(a.snap, b.snap) AS snap,
    CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
         WHEN a.mtime_ms IS DISTINCT FROM b.mtime_ms OR a.size IS DISTINCT FROM b.size THEN 'changed' END AS state
  FROM held a FULL JOIN b ON a.vault = b.vault AND a.snap = b.snap AND a.path = b.path)
SELECT vault, snap, true AS stale, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed,
  count(*) FILTER (state = 'removed') AS removed FROM d WHERE state IS NOT NULL GROUP BY vault, snap"""
_MANIFEST_SNAPS = f"""
WITH {_HELD}
SELECT vault, snap, sha256(string_agg(path || ' ' || coalesce(size::VARCHAR, '') || ' ' || mtime_ms::VARCHAR || chr(10), '' ORDER BY path)) AS manifest_hash
FROM held WHERE size IS NOT NULL GROUP BY vault, snap"""

# the links of the rendered notes as they must be read
_WRITTEN = """
raw AS (
  SELECT note_id, vault, path AS src, (i - 1)::INT AS pos, out_links[i] AS x
  FROM (SELECT note_id, vault, path, out_links, unnest(range(1, len(out_links) + 1)) AS i FROM notes) WHERE NOT regexp_matches(out_links[i], '[\\[\\]\\n]')),
written AS (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS nth, pos % 4 = 3 AND NOT regexp_matches(x, '[()<>%"''\\s]') AS md,
    CASE pos % 4 WHEN 1 THEN x || '#Top|shown' WHEN 2 THEN x || '^b1' ELSE x END AS inside, pos % 4 = 2 AS embed FROM raw),
cutup AS (
  SELECT *, CASE WHEN contains(inside, '|') THEN inside[:strpos(inside, '|') - 1] ELSE inside END AS bare,
    CASE WHEN contains(inside, '|') THEN inside[strpos(inside, '|') + 1:] END AS shown FROM written),
seen AS (
  SELECT note_id, vault, src, pos, nth, md, embed, CASE WHEN md THEN x ELSE regexp_extract(bare, '^[^#^]*') END AS target,
    CASE WHEN regexp_matches(bare, '[#^]') AND NOT md THEN regexp_replace(bare, '^[^#^]*[#^]', '') END AS anchor,
    CASE WHEN md THEN 'label' ELSE shown END AS shown,
    CASE WHEN md THEN '[label](' || x || ' "title")' ELSE CASE WHEN embed THEN '!' ELSE '' END || '[[' || inside || ']]' END AS before
  FROM cutup
  WHERE NOT md OR (x <> '' AND NOT regexp_matches(x, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//|#)')
    AND (NOT regexp_matches(regexp_extract(x, '[^/]*$'), '.\\.[^.]*$') OR regexp_matches(lower(x), '\\.(md|markdown)$'))))"""
_O = _LINKS[_LINKS.index("o AS (") : _LINKS.index("r AS (")]
_SEEN_LINKS = _LINKS.replace(_O, f"""{_WRITTEN.strip()},
o AS (SELECT note_id, vault, src, pos, target, {sql_norm("target")} AS name, nth, md, embed, anchor, shown, before FROM seen WHERE target <> ''),
""").replace("SELECT o.vault, o.src, o.pos, o.target, o.name,", "SELECT o.*,")
_PLAN = f"""
WITH best AS (WITH {_LINKS} SELECT vault, dst FROM back GROUP BY vault, dst ORDER BY count(*) DESC, vault, dst LIMIT 1),
{_SEEN_LINKS}
SELECT src AS path, (nth + 4)::INT AS line, before, {{0}} AS after
FROM r JOIN best ON best.vault = r.vault AND best.dst = resolved WHERE before <> {{0}} AND {{1}}"""
_MOVED = """CASE WHEN md THEN '[label](' || CASE WHEN contains(target, '/') THEN 'archive/renamed note.md' ELSE 'renamed note.md' END || ' "title")'
  ELSE CASE WHEN embed THEN '!' ELSE '' END || '[[' || CASE WHEN contains(target, '/') THEN 'archive/renamed note' ELSE 'renamed note' END
    || coalesce('#' || anchor, '') || coalesce('|' || shown, '') || ']]' END"""

QUERIES: dict[str, Query] = {
    "weighted_tf": _on(_posted, "notes"),
    "doc_lengths": _on(_lengths, "notes"),
    "corpus_stats": _on(lambda n: index.corpus_stats(_lengths(n), _posted(n)), "notes"),
    "document_frequency": _on(lambda n: index.document_frequency(_posted(n)), "notes"),
    "attribute_postings": _on(lambda n: index.attributes(n, "note_id"), "notes"),
    "attribute_postings_filterable": _on(lambda n: index.attributes(n, "note_id", ["Status", "tags"]), "notes"),
    "attribute_census": _on(_census, "notes"),
    "attribute_census_scoped": _on(lambda n: _census(n, "inbox/"), "notes"),
    "attribute_report": _on(_attr_report, "notes"),
    "attribute_values": _on(lambda n: attrs.values_of(index.attributes(n, "note_id"), "Status"), "notes"),
    "search": _on(lambda n: _search(n, search.SearchQuery(TERMS, limit=25)), "notes"),
    "search_filtered": _on(
        lambda n: _search(n, search.SearchQuery(TERMS, {"Status": ["draft", "Done"], "type": ["note"]}, {"rating": ["1"]}, limit=50)), "notes"
    ),
    "search_prefix": _on(lambda n: _search(n, search.SearchQuery(TERMS, path_prefix="inbox/", limit=50)), "notes"),
    "search_batch": _on(_batch, "notes"),
    "similar_batch": _on(_similar, "notes"),
    "resolved_links": _on(links.resolved_links, "notes"),
    "backlinks": _on(lambda n: links.backlinks(links.resolved_links(n)), "notes"),
    "broken_links": _on(lambda n: links.broken_links(links.resolved_links(n)), "notes"),
    "ambiguous_links": _on(lambda n: links.ambiguous_links(links.resolved_links(n)), "notes"),
    "unlinked_notes": _on(lambda n: links.unlinked_notes(n, links.resolved_links(n)), "notes"),
    "name_collisions": _on(doctor.name_collisions, "notes"),
    "oversized": _on(lambda n: doctor.oversized(n, 100), "notes"),
    "malformed_frontmatter": _on(doctor.malformed_frontmatter, "notes"),
    "doctor_report": _on(lambda n: doctor.report(n, 100, "inbox/"), "notes"),
    "staleness": _on(_staleness, "files"),
    "manifest_hash": _on(lambda f: manifest_hash(_latest(f, "2025-06").where("size IS NOT NULL"), ["vault"]), "files"),
    "staleness_snaps": _on(_staleness_snaps, "files"),
    "manifest_hash_snaps": _on(_manifest_hash_snaps, "files"),
    "rename_plan": _on(lambda n: _plan(n, "archive/renamed note.md"), "notes"),
    "delete_plan": _on(lambda n: _plan(n, None), "notes"),
    "parsed_links": _on(_parsed_links, "notes"),
    "links_to": _on(lambda n: links.links_to(n, links.backlinks(links.resolved_links(n)), *_most_linked(n)), "notes"),
    "links_from": _on(lambda n: links.links_from(links.resolved_links(n), *_most_linked(n)), "notes"),
    "parsed_documents": _on(_parsed_documents, "documents"),
    "tokens": _on(_tokens, "documents"),
    "stems": _on(_stems, "documents"),
    "document_search": _on(_document_search, "documents"),
}
ORACLE: dict[str, str] = {
    "weighted_tf": f"WITH {_OCC} SELECT term, doc_id, wtf FROM posted",
    "doc_lengths": f"WITH {_OCC} SELECT doc_id, length FROM lens",
    "corpus_stats": f"""WITH {_OCC} SELECT 3 AS format_version, n::BIGINT AS doc_count, av AS avg_length,
      (SELECT count(*) FROM df) AS term_count, (SELECT count(*) FROM posted) AS posting_count FROM st""",
    "document_frequency": f"WITH {_OCC} SELECT term, df FROM df",
    "attribute_postings": f"WITH {_OCC} SELECT doc_id, key, value FROM attr",
    "attribute_postings_filterable": f"WITH {_OCC} SELECT doc_id, key, value FROM attr WHERE key IN ('status', 'tags')",
    "attribute_census": f"WITH {_OCC} SELECT key, value, count(*) AS doc_count FROM attr GROUP BY key, value",
    "attribute_census_scoped": f"""WITH {_OCC} SELECT key, value, count(*) AS doc_count FROM attr JOIN notes ON note_id = doc_id
      WHERE starts_with(path, 'inbox/') GROUP BY key, value""",
    "attribute_report": f"""WITH {_OCC}, c AS (SELECT key, value, count(*) AS doc_count FROM attr GROUP BY key, value),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_count DESC, value) AS r FROM c)
      SELECT key, sum(doc_count)::BIGINT AS occurrences, count(*) AS distinct_values, count(*) > 5 AS truncated,
        string_agg(value || ':' || doc_count, '|' ORDER BY r) FILTER (r <= 5) AS shown FROM ranked GROUP BY key""",
    "attribute_values": f"WITH {_OCC} SELECT DISTINCT value FROM attr WHERE key = 'status'",
    "search": _sql_search("true", 25),
    "search_filtered": _sql_search(f"{_has('status', 'draft', 'done')} AND {_has('type', 'note')} AND NOT {_has('rating', '1')}", 50),
    "search_prefix": _sql_search("starts_with(notes.path, 'inbox/')", 50),
    "search_batch": _sql_batch(_Q_TITLES, ""),
    "similar_batch": _sql_batch(_Q_BODY, "WHERE p.doc_id <> q.query_id"),
    "resolved_links": f"WITH {_LINKS} SELECT * FROM r",
    "backlinks": f"WITH {_LINKS} SELECT * FROM back",
    "broken_links": f"WITH {_LINKS} SELECT * FROM broken",
    "ambiguous_links": f"WITH {_LINKS} SELECT * FROM ambiguous",
    "unlinked_notes": f"WITH {_LINKS} SELECT * FROM unlinked",
    "name_collisions": f"WITH {_LINKS} SELECT * FROM collide",
    "oversized": "SELECT vault, path, word_count FROM notes WHERE word_count > 100",
    "malformed_frontmatter": "SELECT vault, path FROM notes WHERE frontmatter_malformed",
    "doctor_report": f"""WITH {_LINKS}
      SELECT 'brokenLinks' AS finding, vault, target AS name, referrer AS path FROM broken WHERE starts_with(referrer, 'inbox/')
      UNION ALL SELECT 'oversized', vault, word_count::VARCHAR, path FROM notes WHERE word_count > 100 AND starts_with(path, 'inbox/')
      UNION ALL SELECT 'duplicateTitles', vault, name, path FROM collide
        QUALIFY bool_or(starts_with(path, 'inbox/')) OVER (PARTITION BY vault, name)
      UNION ALL SELECT 'ambiguousLinks', vault, target, referrer FROM ambiguous WHERE starts_with(referrer, 'inbox/')
      UNION ALL SELECT 'malformedFrontmatter', vault, NULL, path FROM notes WHERE frontmatter_malformed AND starts_with(path, 'inbox/')
      UNION ALL SELECT 'orphans', vault, NULL, path FROM unlinked WHERE starts_with(path, 'inbox/')""",
    "staleness": _STALE,
    "manifest_hash": _MANIFEST,
    "staleness_snaps": _STALE_SNAPS,
    "manifest_hash_snaps": _MANIFEST_SNAPS,
    "rename_plan": _PLAN.format(_MOVED, "true"),
    "delete_plan": _PLAN.format("coalesce(shown, target)", "src <> dst"),
    "parsed_links": f"""WITH {_WRITTEN} SELECT note_id, (row_number() OVER (PARTITION BY note_id ORDER BY md, pos) - 1)::INT AS pos, target FROM seen""",
    "links_to": f"""WITH {_LINKS}, best AS (SELECT vault, dst FROM back GROUP BY vault, dst ORDER BY count(*) DESC, vault, dst LIMIT 1)
      SELECT path, title FROM notes WHERE (vault, path) IN (SELECT back.vault, src FROM back JOIN best USING (vault, dst))""",
    "links_from": f"""WITH {_LINKS}, best AS (SELECT vault, dst FROM back GROUP BY vault, dst ORDER BY count(*) DESC, vault, dst LIMIT 1)
      SELECT target, resolved AS "resolvedPath" FROM r JOIN best ON best.vault = r.vault AND dst = src""",
    "tokens": _TOKENS,
}
