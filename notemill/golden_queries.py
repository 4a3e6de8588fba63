"""Queries over small fixtures whose right results are known and stated as SQL values, for what SQL cannot compute:
stemmer, parser, snippets, globs, destinations, and the ranking of a tiny corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parser import parse_notes
from .functions.snippets import snippet_column
from .functions.stemmer import stem_column
from .functions.text import split_words, tokens
from .operators import index, rewrite, search
from .sources.vault import glob_pattern

Query = Callable[[SparkSession, str], DataFrame]

# Published examples of the stemmer.
STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat "
    "troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky "
    "relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic "
    "differentli differ vileli vile analogousli analog vietnamization vietnam triplicate triplic formative form hopeful hope goodness good "
    "revival reviv adjustment adjust sensitiviti sensit sensibiliti sensibl probate probat cease ceas controlling control meet meet run run is is by by"
).split()
#: Text, its word runs and parts, and its terms.
TOKENS = [
    ("Hello World", "hello world", "hello world"), ("parseFrontmatter", "parsefrontmatter parse frontmatter", "parsefrontmatter parse frontmatter"),
    ("HTMLParser", "htmlparser html parser", "htmlparser html parser"), ("parse_frontmatter", "parse frontmatter", "parse frontmatter"),
    ("html5parser", "html5parser html 5 parser", "html5parser html parser"), ("café résumé", "café résumé", "café résumé"),
    ("hello, world!", "hello world", "hello world"), ("this is a meeting", "this is a meeting", "meeting"), ("", "", ""),
]
#: Pattern, path, whether they match.
GLOBS = [
    ("*.md", "note.md", True), ("*.md", "sub/note.md", False), ("a?c.md", "abc.md", True), ("a?c.md", "ac.md", False), ("a?c.md", "abbc.md", False),
    (".git/**", ".git/objects/abc", True), (".git/**", ".git/HEAD", True), (".git/**", ".git", True), (".git/**", ".github", False),
    (".git/**", ".github/workflows/ci.yml", False), ("**/*.tmp", "a.tmp", True), ("**/*.tmp", "a/b/c.tmp", True), ("a.b", "a.b", True), ("a.b", "aXb", False),
    ("a+b.md", "a+b.md", True), ("note.md", "sub/note.md", False), ("note.md", "note.md.bak", False), ("**", "x/y/z", True), ("d/**/f.md", "d/e/g/f.md", True),
]
#: Source, destination, the normalised path.
DESTINATIONS = [
    ("a/b.md", "c", "a/c.md"), ("a/b.md", "d/c.md", "d/c.md"), ("a/b.md", "d/", "d/b.md"), ("b.md", "c", "c.md"), ("b.md", "c.markdown", "c.markdown.md"),
    ("a/b.md", "/", "b.md"), ("a/b.md", "./d//c", "d/c.md"), ("a/b.md", "C.MD", "a/C.MD"),
]
#: Text, terms, window, snippet.
SNIPPETS = [
    ("quick brown fox", "zebra", 200, None), ("quick brown fox", "", 200, None), ("short text with a match inside it", "match", 200, "short text with a match inside it"),
    ("one   two\n\nthree\ttarget\tfour    five", "target", 200, "one two three target four five"), ("Some TARGET word", "target", 200, "Some TARGET word"),
    ("Alpha begins a sentence that goes on for long", "alpha", 10, "Alpha begins …"), ("a sentence that goes on for long until omega", "omega", 10, "… until omega"),
    ("left side middle right side", "middle", 8, "… side middle right …"),
]
_FRONT = "---\n"
#: File name, source, and what is read: title; headings; links; tags; aliases; malformed, link in front matter, words.
NOTES = [
    ("plain.md", "Just words, three.", "plain;;;;;false false 3"),
    ("empty.md", "", "empty;;;;;false false 0"),
    ("rule.md", "Intro.\n\n---\n\nMore.", "rule;;;;;false false 3"),
    ("f.md", _FRONT + "title: Hello\nstatus: draft\n---\nBody here.", "Hello;;;;;false false 2"),
    ("dots.md", _FRONT + "title: Hello\n...\nBody.", "Hello;;;;;false false 1"),
    ("crlf.md", "---\r\ntitle: Hello\r\n---\r\nBody text.", "Hello;;;;;false false 2"),
    ("bad.md", _FRONT + "a: [\n---\n# H\nx", "H;H;;;;true false 3"),
    ("list.md", _FRONT + "- a\n- b\n---\nx", "list;;;;;true false 1"),
    ("open.md", _FRONT + "title: X\nno end", "open;;;;;true false 4"),
    ("link.md", _FRONT + "title: X\nproject: \"[[Foo]]\"\n---\nBody.", "X;;;;;false true 1"),
    ("heads.md", "# Title\n\n## Sub Heading ##\n\n### Third\n#No\n", "Title;Title|Sub Heading|Third;;no;;false false 9"),
    ("h1.md", "## Not first\n\n# The First\n\nBody.", "The First;Not first|The First;;;;false false 7"),
    ("fence.md", "```\n# no\n[[No]] #no\n```\n[[Yes]] #yes", "fence;;Yes;yes;;false false 8"),
    ("span.md", "A `[[No]]` and [[Yes]].", "span;;Yes;;;false false 4"),
    ("indent.md", "[[Yes]].\n\n    [[No]] #no\n", "indent;;Yes;;;false false 3"),
    ("wiki.md", "[[A]] [[B|b]] [[C#h]] [[D#h|d]] [[E^i]] [[#here]] ![[f.png]]", "wiki;;A|B|C|D|E||f.png;;;false false 7"),
    ("md.md", "[a](other.md \"T\") [b](my%20note.md) [c](https://x.org/a.md) [d](#s) [e](pic.png) [f](<g h.md>) [i](%zz) ![j](k.md)", "md;;other.md|my note.md|g h.md|%zz;;;false false 10"),
    ("tags.md", _FRONT + "tags: [One, two]\naliases: [First, '', Second]\n---\n#Two #a/b #2025 x#no #x-y", "tags;;;a/b|one|two|x-y;First|Second;false false 5"),
    ("alias.md", _FRONT + "alias: Only\nTITLE: Key case\n---\n", "Key case;;;;Only;false false 0"),
]
#: The corpus of the ranking examples: body terms, status, project.
CORPUS = [("alpha beta", "draft", "apollo"), ("alpha", "draft", "zeta"), ("alpha alpha", "final", "apollo"), ("beta gamma", "final", "zeta"), ("gamma", "draft", "apollo")]
_ALL = ["alpha", "beta", "gamma"]
#: Query, and the documents it must give; a list in order, a set in any.
SEARCHES = {
    "beta": (search.SearchQuery(["beta"]), [0, 3]),
    "alpha": (search.SearchQuery(["alpha"]), [2, 1, 0]),
    "zeta": (search.SearchQuery(_ALL, {"project": ["zeta"]}), {1, 3}),
    "and": (search.SearchQuery(_ALL, {"status": ["draft"], "project": ["apollo"]}), {0, 4}),
    "or": (search.SearchQuery(_ALL, {"project": ["apollo", "zeta"], "status": ["final"]}), {2, 3}),
    "none": (search.SearchQuery(["alpha"], {"status": ["archived"]}), []),
    "not": (search.SearchQuery(_ALL, not_filters={"status": ["draft"]}), {2, 3}),
    "prefix": (search.SearchQuery(_ALL, path_prefix="notes/doc-0"), [0]),
    "unknown": (search.SearchQuery(["alpha", "zzz"]), [2, 1, 0]),
}
#: tf, df, N, length, average.
SCORES = [(3, 2, 10, 50, 40), (4, 5, 100, 30, 30), (2, 3, 20, 999, 0), (2, 3, 20, 999, -5)]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, int)):
        return str(v).lower()
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"


def values_sql(columns: str, rows) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


def _table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema).repartition(2)


def _pairs() -> list[tuple[str, str]]:
    return list(zip(STEMS[::2], STEMS[1::2]))


def stem_goldens(spark: SparkSession, _: str) -> DataFrame:
    return stem_column(_table(spark, _pairs(), "word string, x string").select("word", F.col("word").alias("stem")), "stem")


def token_goldens(spark: SparkSession, _: str) -> DataFrame:
    t = _table(spark, TOKENS, "text string, a string, b string")
    return t.select("text", F.concat_ws(" ", split_words(F.col("text"))).alias("words"), F.concat_ws(" ", tokens(F.col("text"))).alias("terms"))


def glob_goldens(spark: SparkSession, _: str) -> DataFrame:
    rows = [(p, x, glob_pattern(p)) for p, x, _ in GLOBS]
    return _table(spark, rows, "pattern string, path string, re string").select("pattern", "path", F.expr("path rlike re").alias("hit"))


def destination_goldens(spark: SparkSession, _: str) -> DataFrame:
    return _table(spark, [(a, b, rewrite.normalise_destination(a, b)) for a, b, _ in DESTINATIONS], "source string, wanted string, path string")


def snippet_goldens(spark: SparkSession, _: str) -> DataFrame:
    out = None
    for width in sorted({w for _, _, w, _ in SNIPPETS}):
        t = _table(spark, [(x, m, w) for x, m, w, _ in SNIPPETS if w == width], "text string, terms string, width int")
        rows = t.select("text", "terms", "width", snippet_column(F.col("text"), F.filter(F.split("terms", " "), lambda x: x != ""), width).alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out


def parser_goldens(spark: SparkSession, _: str) -> DataFrame:
    p = parse_notes(_table(spark, [(n, s) for n, s, _ in NOTES], "name string, source string"), ["name"], "name", "source")
    several = lambda c: F.concat_ws("|", c)
    flags = F.concat_ws(" ", F.col("frontmatter_malformed").cast("string"), F.col("frontmatter_links").cast("string"), F.col("word_count").cast("string"))
    return p.select("name", F.concat_ws(";", "title", several("headings"), several("out_links"), several(F.array_sort("tags")), several("aliases"), flags).alias("note"))


def search_goldens(spark: SparkSession, _: str) -> DataFrame:
    rows = [(i, f"notes/doc-{i}.md", [(w, "body") for w in t.split()], {"status": [s], "project": [p]}) for i, (t, s, p) in enumerate(CORPUS)]
    notes = spark.createDataFrame(rows, "note_id long, path string, terms array<struct<term:string,field:string>>, attributes map<string,array<string>>")
    terms = index.indexed_terms(notes)
    lengths = index.doc_lengths(notes.select(F.col("note_id").alias("doc_id")), terms)
    docs, posted, held = notes.select(F.col("note_id").alias("doc_id"), "path").join(lengths, "doc_id"), index.postings(terms), index.attributes(notes, "note_id")
    avg = sum(len(t.split()) for t, _, _ in CORPUS) / len(CORPUS)
    out = None
    for name, (q, want) in SEARCHES.items():
        hits = search.search(posted, docs, held, q, len(CORPUS), avg)
        pos = F.col("rank") if isinstance(want, list) else F.lit(0)
        row = hits.select(F.lit(name).alias("query"), pos.cast("int").alias("place"), "doc_id", F.concat_ws(" ", "matched_terms").alias("matched"))
        row = row if name == "unknown" else row.withColumn("matched", F.lit(""))
        out = row if out is None else out.unionByName(row)
    return out


def score_goldens(spark: SparkSession, _: str) -> DataFrame:
    out = None
    for tf, df, n, length, avg in SCORES:
        s = search.term_score(F.lit(tf), F.lit(df), F.lit(length), n, avg)
        row = spark.range(1).select(*(F.lit(v).cast("int").alias(c) for c, v in (("tf", tf), ("df", df), ("n", n), ("len", length), ("av", avg))), F.round(s, 9).alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def _searches():
    for name, (_, want) in SEARCHES.items():
        for place, doc in enumerate(want, 1):
            yield name, place if isinstance(want, list) else 0, doc, "alpha" if name == "unknown" else ""


QUERIES: dict[str, Query] = {
    "stem_goldens": stem_goldens, "token_goldens": token_goldens, "glob_goldens": glob_goldens, "destination_goldens": destination_goldens,
    "snippet_goldens": snippet_goldens, "parser_goldens": parser_goldens, "search_goldens": search_goldens, "score_goldens": score_goldens,
}
ORACLE: dict[str, str] = {
    "stem_goldens": values_sql("word, stem", _pairs()),
    "token_goldens": values_sql("text, words, terms", TOKENS),
    "glob_goldens": values_sql("pattern, path, hit", GLOBS),
    "destination_goldens": values_sql("source, wanted, path", DESTINATIONS),
    "snippet_goldens": values_sql("text, terms, width, snippet", SNIPPETS),
    "parser_goldens": values_sql("name, note", [(n, x) for n, _, x in NOTES]),
    "search_goldens": "SELECT query, place::INT AS place, doc_id::BIGINT AS doc_id, matched FROM (" + values_sql("query, place, doc_id, matched", _searches()) + ")",
    "score_goldens": """SELECT tf::INT AS tf, df::INT AS df, n::INT AS n, len::INT AS len, av::INT AS av,
      round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * CASE WHEN av > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * len / av ELSE 1 END), 9) AS score
      FROM (""" + values_sql("tf, df, n, len, av", SCORES) + ")",
}
