import os

import pytest
from pyspark.sql import functions as F

from notemill import config
from notemill.errors import NoIndexError, NotemillError, StaleIndexError
from notemill.operators import doctor, links, rewrite, staleness
from notemill.operators.components import components
from notemill.plans.vault import Vault
from notemill.sources.vault import matches_glob, read_notes, scan

GRAPH = "vault string, path string, title string, aliases array<string>, out_links array<string>, word_count int, frontmatter_malformed boolean"


def graph(spark, rows):
    return spark.createDataFrame([("v", p, t, a, o, 10, False) for p, t, a, o in rows], GRAPH)


def test_cascade_and_ambiguity(spark):
    n = graph(spark, [
        ("x/target.md", "Alpha", [], ["y/target", "X/TARGET.MD", "target", "beta", "nick", "dup", "ghost ", "", "v1.2", "wrong/dir/target"]),
        ("y/target.md", "Beta", ["nick"], ["x/target.md", "x/target.md"]),
        ("z/self.md", "Self", ["dup", "dup"], ["self"]),
        ("v1.md", None, None, None),
        ("alone.md", "Alone", [], []),
        ("blank.md", "Blank", [], [""]),
    ])
    r = links.resolved_links(n)
    got = {(x["src"], x["pos"]): (x["resolved"], x["candidates"]) for x in r.collect()}
    want = ["y/target.md", "x/target.md", "x/target.md", "y/target.md", "y/target.md", "z/self.md", None, None, "v1.md", "x/target.md"]
    assert [got["x/target.md", i][0] for i in range(10)] == want
    assert [got["x/target.md", i][1] for i in (1, 2, 5, 6)] == [1, 2, 2, 0]
    assert {(x["target"], x["referrer"]) for x in links.broken_links(r).collect()} == {("ghost", "x/target.md")}
    assert {x["target"] for x in links.ambiguous_links(r).collect()} == {"target", "dup", "wrong/dir/target"}
    assert ("z/self.md", "z/self.md") in {(x["dst"], x["src"]) for x in links.backlinks(r).collect()}
    assert {x["path"] for x in links.unlinked_notes(n, r).collect()} == {"alone.md"}
    assert {(x["target"], tuple(x["referrers"])) for x in links.by_target(links.broken_links(r)).collect()} == {("ghost", ("x/target.md",))}
    assert links.resolved_links(n.limit(0)).count() == 0


def test_doctor_prefix_narrows_the_report_only(spark):
    n = graph(spark, [("notes/a.md", "Same", [], ["out", "ghost"]), ("other/out.md", "same ", [], ["ghost2"]), ("other/b.md", "B", ["same"], None)])
    r = {(x["finding"], x["name"], x["path"]) for x in doctor.report(n, 5, "notes/").collect()}
    assert r == {("brokenLinks", "ghost", "notes/a.md"), ("oversized", "10", "notes/a.md")} | {
        ("duplicateTitles", "same", p) for p in ("notes/a.md", "other/out.md", "other/b.md")
    }


@pytest.mark.parametrize("pattern, path, yes", [
    ("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "a.md", True), ("**/*.md", "d/e/a.md", True), (".git/**", ".git", True),
    (".git/**", ".git/x/y", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a.c", "abc", False), ("**", "x/y", True), ("d/**/f.md", "d/f.md", True),
])
def test_globs(pattern, path, yes):
    assert matches_glob(pattern, path) is yes


def put(root, path, text, mode="w"):
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, mode) as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    root = str(tmp_path / "vault")
    os.makedirs(root)
    Vault.init(root)
    put(root, "notes/Deep Work.md", "---\ntags: [Focus, life/work]\nstatus: Draft\naliases: [dw]\n---\n# Deep Work\nQuiet sourdough hydration hours. #calm\n")
    put(root, "notes/b.MD", "# B\nSee [[Deep Work#top|deep]] and ![[notes/Deep Work]] and [text](Deep%20Work.md \"t\").\n`[[Deep Work]]` [[ghost]]\n")
    put(root, "c.markdown", "sourdough sourdough [[dw]] \n")
    put(root, ".git/x.md", "no")
    put(root, "bad.md", b"\xff\xfe\x00", "wb")
    put(root, "plain.txt", "no")
    os.symlink(os.path.join(root, "notes"), os.path.join(root, "loop"))
    return root


def test_scan_and_read(spark, folder):
    c = config.load(folder)
    assert {r["path"] for r in scan(spark, c).collect()} == {"notes/Deep Work.md", "notes/b.MD", "c.markdown", "bad.md"}
    notes, skipped = read_notes(spark, c)
    assert notes.count() == 3 and [tuple(r) for r in skipped.collect()] == [("bad.md", "not valid UTF-8: invalid start byte at byte 0")]


def test_vault_round_trip(spark, folder):
    v = Vault(spark, os.path.join(folder, "notes"))
    assert v.status()["indexed"] is False
    with pytest.raises(NoIndexError):
        v.tables()
    s = v.index()
    assert s["docCount"] == 3 and s["skipped"] == [{"path": "bad.md", "reason": "not valid UTF-8: invalid start byte at byte 0"}]
    assert [r["doc_id"] for r in v.tables()["docs"].orderBy("path").collect()] == [0, 1, 2]
    hits = v.search("sourdough hydration").collect()
    assert [h["path"] for h in hits] == ["notes/Deep Work.md", "c.markdown"]
    assert hits[0]["tags"] == ["calm", "focus", "life/work"] and "sourdough" in hits[0]["snippet"]
    assert [h["path"] for h in v.search("sourdough", filters=["STATUS= draft "], tags=["focus"]).collect()] == ["notes/Deep Work.md"]
    assert v.search("the of").count() == 0
    assert [h["path"] for h in v.similar("c").collect()] == ["notes/Deep Work.md"]
    assert {r["path"] for r in v.links_to("dw").collect()} == {"notes/b.MD", "c.markdown"}
    assert [tuple(r) for r in v.links_from("b").collect()][-1] == ("Deep Work.md", "notes/Deep Work.md")
    assert [tuple(r) for r in v.broken().collect()] == [("ghost", ["notes/b.MD"])]
    assert v.attrs().where("key = 'tags'").first()["occurrences"] == 3
    assert "orphans" not in {r["finding"] for r in v.doctor().collect()}
    with pytest.raises(NotemillError):
        v.resolve("nothing at all")
    dry = v.rename("Deep Work", "Calm", dry_run=True)
    assert dry["to"] == "notes/Calm.md" and dry["fileCount"] == 2
    assert [e["after"] for e in dry["edits"]] == ["[[Calm]]", "[[Calm#top|deep]]", "![[notes/Calm]]", '[text](Calm.md "t")']
    assert [e["line"] for e in dry["edits"]] == [1, 2, 2, 2]
    v.rename("Deep Work", "Calm")
    with open(os.path.join(folder, "notes/b.MD")) as f:
        assert "[[Calm#top|deep]]" in f.read()
    assert os.path.exists(os.path.join(folder, "notes/Calm.md"))
    assert v.status()["stale"] is True
    with pytest.raises(StaleIndexError):
        v.rename("c", "d")
    v.index()
    plan = v.remove("Calm", confirmed=True)
    assert [e["after"] for e in plan["edits"] if e["path"] == "notes/b.MD"] == ["deep", "notes/Calm", "text"]
    assert not os.path.exists(os.path.join(folder, "notes/Calm.md"))


def test_config_round_trip(tmp_path):
    root = str(tmp_path)
    Vault.init(root)
    assert config.load(root) == config.VaultConfig(root)
    put(root, ".notemill/config.yaml", "bm25: {k1: 2, b: no}\nfield_weights: {title: 9, body: x}\nextensions: [.TXT]\nsplit_threshold_words: many\n")
    c = config.load(root)
    assert (c.k1, c.b, c.extensions, c.split_threshold_words, c.field_weights["title"], c.field_weights["body"]) == (2.0, 0.75, (".txt",), 1200, 9.0, 1.0)
    assert config.find_root(os.path.join(root, "x", "y")) == root
    put(root, ".notemill/config.yaml", ": [")
    assert config.load(root) == config.VaultConfig(root)


def test_destinations():
    f = rewrite.normalise_destination
    assert f("a/b.md", "c") == "a/c.md" and f("a/b.md", "d/c.md") == "d/c.md" and f("a/b.md", "d/") == "d/b.md"
    assert f("b.md", "c.markdown") == "c.markdown.md" and f("a/b.md", "/") == "b.md" and f("a/b.md", "d", lambda p: p == "d") == "d/b.md"


def test_rewritten_snapshot(spark):
    texts = spark.createDataFrame([("a.md", "[[b]] x [[b|y]]"), ("b.md", "own")], "path string, text string")
    edits = spark.createDataFrame([("a.md", 1, "[[b]]", "[[c]]", 0, 5), ("a.md", 1, "[[b|y]]", "[[c|y]]", 8, 15)], "path string, line int, before string, after string, start int, end int")
    got = {tuple(r) for r in rewrite.rewritten(texts, edits, "b.md", "c.md").collect()}
    assert got == {("a.md", "[[c]] x [[c|y]]"), ("c.md", "own")}
    assert {r["path"] for r in rewrite.rewritten(texts, edits, "b.md", None).collect()} == {"a.md"}


def test_staleness(spark):
    a = spark.createDataFrame([("n", 1, 1), ("same", 1, None), ("ch", 2, 1)], "path string, mtime_ms long, size long")
    b = spark.createDataFrame([("same", 1, None), ("ch", 1, 1), ("rm", 1, 1)], "path string, mtime_ms long, size long")
    assert tuple(staleness.staleness(a, b).first()) == (True, 1, 1, 1)
    assert tuple(staleness.staleness(a, a).first()) == (False, 0, 0, 0)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (20, 10), (10, 30)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(e, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7, 5: 5, 20: 10, 10: 10, 30: 10} | {100 + i: 100 for i in range(41)}
    assert components(e.limit(0), "a", "b").count() == 0


def test_stream_ingest(spark, tmp_path):
    from notemill.streaming.ingest import append_to

    spark.createDataFrame([("a.md", "# A\n[[b]]")], "path string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["title"], r["out_links"]) for r in rows] == [("A", ["b"])]
