from notemill.functions.parser import code_spans, file_stem, parse_note, parse_notes


def test_frontmatter_forms():
    assert parse_note("", "a.md").present is False
    assert parse_note("text\n---\nx: 1\n---\n", "a.md").present is False
    n = parse_note("---\r\nTitle: T \r\nn: 3\r\nok: true\r\nd: 2024-01-02\r\nyes: yes\r\nm: {a: 1}\r\nl: [A, ' ', b]\r\n...\r\nbody", "a.md")
    assert (n.title, n.body, n.malformed) == ("T", "body", False)
    assert n.attributes == {"title": ["t"], "n": ["3"], "ok": ["true"], "d": ["2024-01-02"], "yes": ["yes"], "l": ["a", "b"]}
    for bad in ("---\n- a\n---\nb", "---\na: [\n---\nb", "---\na: 1\na: 2\n---\nb"):
        n = parse_note(bad, "f.md")
        assert n.malformed and n.data == {} and n.body == "b"
    n = parse_note("---\na: '[[x]]'\nno end", "f.md")
    assert n.malformed and not n.frontmatter_links and n.body.startswith("a:")
    assert parse_note("---\na: '[[x]]'\n---\n", "f.md").frontmatter_links
    assert not parse_note("---\n---\nb", "f.md").malformed


def test_code_spans_hide_links():
    text = "```\n[[a]]\n```\n\n    [[b]]\n\n- item\n\n    [[c]]\n`[[d]]` ``x` [[e]]``\n~~~\n[[f]]"
    n = parse_note(text, "x.md")
    assert [w["target"] for w in n.wiki] == ["c"]
    assert all(0 <= a < b <= len(text) for a, b in code_spans(text))


def test_headings_title_tags():
    n = parse_note("# One ##\n## Two\n#tag not\n text #a/b #12 #c\n###### six\n####### seven\n", "dir/File.name.md")
    assert n.headings == ["One", "Two", "six"] and n.title == "One"
    assert n.inline_tags == ["tag", "a/b", "c"]
    assert parse_note("#\n# Later", "dir/File.name.md").title == "File.name"
    assert file_stem(".hidden") == ".hidden" and file_stem("a/b.c.md") == "b.c"


def test_links():
    n = parse_note("[[T#h|al]] ![[img.png]] [[x^b]] [z](a%20b.md 'q') [w](http://x) [p](<c d.md>) ![i](i.md) [q](q.pdf) [r](#s) [e]()", "a.md")
    assert [(w["target"], w["anchor"], w["alias"], w["embed"]) for w in n.wiki] == [("T", "h", "al", False), ("img.png", None, None, True), ("x", "b", None, False)]
    assert [x["target"] for x in n.links] == ["a b.md", "c d.md"]


def test_parse_notes_table(spark):
    df = spark.createDataFrame([(1, "a.md", "# H\n[[x]]"), (2, "b.md", None), (3, None, "")], "id int, path string, text string")
    rows = {r["id"]: r for r in parse_notes(df, ["id"], "path", "text").collect()}
    assert rows[1]["out_links"] == ["x"] and rows[1]["title"] == "H"
    assert rows[2]["word_count"] == 0 and rows[2]["title"] == "b" and rows[3]["title"] == ""
