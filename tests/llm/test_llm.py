"""The operators for training text against brute force, round trips and public libraries, with odd inputs."""

import itertools
import json
import math
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import distinct, frequency, lookalike, markup, neardup, packing, tokens

TERM = "array<struct<term:string,field:string>>"
NOTE = f"note_id long, terms {TERM}, attributes map<string,array<string>>"
DOC = "doc_id long, text string"


def terms(*words):
    return [(w, "body") for w in words]


# -- p2 ------------------------------------------------------------------------

CASES = {
    "<b>x</b>": ["html"], "a <br/> b": ["html"], "x &amp; y": ["html"], "&#233;": ["html"], "<!-- c -->": ["html"], "<div\n class='a > b'\n>x": ["html"],
    "---\na: 1\n---\nb": ["markdown"], "# H": ["markdown"], "T\n===": ["markdown"], "a **b** c": ["markdown"], "~~x~~": ["markdown"], "`x`": ["markdown"],
    "```\n<b>[[x]]</b> $x$\n```": ["markdown"], "[a](b.md)": ["markdown"], "![a](b.png)": ["markdown"], "x[^1]": ["markdown"], "> q": ["markdown"],
    "|a|b|\n|---|---|\n|1|2|": ["markdown"], "a\n\n***\n\nb": ["markdown"], "a\n\n    code &amp;": ["markdown"], "[x]: ../y": ["markdown"],
    "[[x|y]]": ["wiki"], "![[x]]": ["wiki"], "== h ==": ["wiki"], "''x''": ["wiki"], "{{t|x}}": ["wiki"], "{|\n! a\n|-\n| 1 || 2\n|}": ["wiki"],
    "\\emph{x}": ["latex"], "\\begin{itemize}\n\\item x\n\\end{itemize}": ["latex"], "a $x^2$ b": ["latex"], "\\(x\\)": ["latex"], "$$\nx\n$$": ["latex"],
    "- [x] item\n* other #tag": [], "from $5 to $12, later $9.": [], "C:\\notes\\text": [], "2 * 3 * 4": [], "keep_last_run": [], "a < b and c > d": [],
    "<folder> <limit>": [], "rows[3]": [], "{red, blue}": [], "x == y == z": [], "R&D, Q&A": [], "C# #1": [], "^C ~/a ~/b": [], "a | b": [], "it's": [],
    "": [], "  \n": [], "<|endoftext|>": [],
}


@pytest.mark.parametrize("text", CASES)
def test_families(text):
    assert markup.clean(text).families == CASES[text]


def test_clean_keeps_structure_and_drops_link_lists():
    page = (
        "<html><body><nav><a href='/'>Home page</a> <a href='/x'>The next page of all</a></nav><div><h2>Title</h2><p>"
        + "Long text, with commas, and more words. " * 5
        + "</p><ul><li>one item</li></ul><pre>a &lt; b\n  c</pre></div><p>A sibling of its own.</p></body></html>"
    )
    c = markup.clean(page)
    kinds = [(k, t) for k, _, t in c.blocks]
    assert ("heading", "Title") in kinds and ("item", "one item") in kinds and ("code", "a < b\n  c") in kinds
    assert "Home page" not in c.text and "A sibling of its own." in c.text
    tex = markup.clean("\\section{S}\nLet $x_1$ be \\textbf{bold}.\n\n- [[A|b]] and [c](d)\n\n```py\nx = 1\n```")
    assert tex.text == "# S\n\nLet x_1 be bold.\n\n- b and c\n\nx = 1"
    assert markup.clean(None) is None and markup.clean("plain").text == "plain"
    markup.clean("[" * 3000 + "{" * 3000 + "*" * 3000 + "<" * 3000 + "`" * 3001)


def test_the_best_container_wins():
    body = "<p>" + "A long paragraph, with commas, that says something at length. " * 4 + "</p>"
    page = (
        "<div id='top'><p>Menu of the site, short.</p></div><div id='main'><h2>T</h2>" + body * 3 + "<ul><li><a href='/a'>one</a><li><a href='/b'>two</a></ul>"
        "<table><tr><td>1</td><td>2</td></tr></table><pre>code</pre></div><ul><li>kept item</li></ul><pre>kept code</pre><p>kept text</p>"
        "<p><a href='/'>Home</a> | <a href='/n'>Next</a></p><footer><p>Made by us, with care, in a small town.</p></footer>"
    )
    text = markup.clean(page).text
    assert all(x in text for x in ("# T", "1 ; 2", "code", "kept item", "kept code", "kept text"))
    assert not any(x in text for x in ("Menu", "one", "two", "Home", "Made by"))
    flat = markup.clean("# Note\n\n" + "Some words, and more of them, in a line. " * 4 + "\n\n- [[A]]\n- [[B|b]]\n\n- an item of words\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert [(k, t) for k, _, t in flat.blocks if k != "p"] == [("heading", "Note"), ("item", "A"), ("item", "b"), ("item", "an item of words"), ("row", "a ; b"), ("row", "1 ; 2")]
    nav = markup.clean("# Note\n\n" + "Some words, and more of them, in a line. " * 4 + "\n\n- [[A]]\n- [[B|b]]\n")
    assert [k for k, _, _ in nav.blocks] == ["heading", "p"]
    assert [t for _, _, t in markup.clean("- [[A]]\n- [[B|b]]").blocks] == ["A", "b"]  # nothing but links: kept whole


LONG = [
    "|a|", "a _b", "\\[ a ", "\\( a ", "<!-- ", "<pre>", "<script>", "{|\n", "\\begin{equation}", "[[a ", "`a ``b ", "**a ", "[a](b) ", "<a href=", "deadbeef", "<p>", "* a\n", "> ",
]


@pytest.mark.parametrize("part", LONG)
def test_very_long_texts_take_linear_time(part):
    def seconds(n):
        began = time.process_time()
        markup.clean(part * n)
        return time.process_time() - began

    assert seconds(40_000) < 40 * max(seconds(4_000), 0.05)  # quadratic time is a hundredfold
    markup.clean("# a" + " " * 40_000 + "b ##")
    assert markup.clean("# a b ##").text == "# a b" and markup.clean("# a#").text == "# a#"


def test_markup_found(spark):
    d = spark.createDataFrame([(1, "<b>x</b> [[y]]"), (2, None), (3, ""), (1, "<b>x</b> [[y]]")], DOC).withColumn("tbl", F.lit("clash"))
    n = spark.createDataFrame([(1, ["`x`", None], terms("$a_i$", None, "plain")), (2, None, None), (3, [], [])], f"note_id long, headings array<string>, terms {TERM}")
    got = sorted(tuple(r) for r in markup.markup_found(d, n).collect())
    assert got == [("documents", 1, "html"), ("documents", 1, "wiki"), ("notes", 1, "latex"), ("notes", 1, "markdown")]
    assert markup.markup_found(d.limit(0), n.limit(0)).count() == 0
    assert markup.clean_documents(d).count() == 4


def test_markup_found_sends_every_case_to_the_cleaner(spark):
    texts = [*CASES, "x\n\n| loom | archive |\n|---|---|\n| relay | 486 |", "a | b\n:--|--:\n1 | 2", "|a|\r\n\t|--|\r\n|1|"]
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    n = spark.createDataFrame([(i, [t], terms(t)) for i, t in enumerate(texts)], f"note_id long, headings array<string>, terms {TERM}")
    want = {(tbl, i, m) for i, t in enumerate(texts) for m in markup.clean(t).families for tbl in ("documents", "notes")}
    assert {i for _, i, m in want if m == "markdown"} >= set(range(len(CASES), len(texts)))
    assert {tuple(r) for r in markup.markup_found(d, n).collect()} == want


def test_clean_texts_keeps_every_place(spark):
    from notemill.llm.queries import QUERIES

    heads = ["# A *b*", None, "plain", "# A *b*", ""]
    words = ["`x`", "x", None, "`x`", "[[a|b]]", "long " * 30 + "<b>y</b>"]
    n = spark.createDataFrame([(1, heads, terms(*words)), (2, None, None), (3, [], [None]), (4, ["$a_i$"], [])], f"note_id long, headings array<string>, terms {TERM}")
    d = spark.createDataFrame([(1, "<b>x</b>"), (2, None), (1, "<b>x</b>")], DOC).withColumn("tbl", F.lit("clash"))
    want = [("documents", i, "text", 0, t) for i, t in ((1, "<b>x</b>"), (2, None), (1, "<b>x</b>"))]
    want += [("notes", 1, f, p, t) for f, ts in (("heading", heads), ("term", words)) for p, t in enumerate(ts)]
    want += [("notes", 3, "term", 0, None), ("notes", 4, "heading", 0, "$a_i$")]

    def row(tbl, i, f, p, t):
        m = markup.clean(t)
        return (tbl, i, f, p, m and m.text, m and m.families, m and m.blocks)

    rows = markup.clean_texts(d, n).collect()
    got = [(*r[:6], r[6] if r[6] is None else [tuple(b) for b in r[6]]) for r in rows]
    assert sorted(map(repr, got)) == sorted(repr(row(*w)) for w in want)
    assert markup.clean_texts(d.limit(0), n.limit(0)).count() == 0
    found = QUERIES["p2_clean"](spark, "/root/testdata/sf0.001").groupBy("tbl", "field").count().collect()
    assert {(r["tbl"], r["field"]) for r in found} == {("documents", "text"), ("notes", "heading"), ("notes", "term")}


# -- p3, p5 ----------------------------------------------------------------------


def zipf_notes(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(i, terms(*[rnd.choice(["a", " A", "b", None, "\u00a0a", f"w{int(rnd.paretovariate(0.6)) % 400}"]) for _ in range(rnd.randint(0, 12))]), {"K ": ["x", " X", "", None], "e": None} if i % 2 else None) for i in range(n)]
    rows += [(1000, None, None), (1001, [], {}), (1002, [None], {"z": []}), rows[0]]
    return rows, spark.createDataFrame(rows, NOTE)


def norm(x):
    return x.strip().lower()


def test_item_counts(spark):
    rows, df = zipf_notes(spark)
    occ, rec = Counter(), Counter()
    for _, ts, at in rows:
        items = [("term", norm(t[0])) for t in ts or [] if t and t[0] is not None]
        items += [("attribute", f"{norm(k)}={norm(v)}") for k, vs in (at or {}).items() for v in vs or [] if v and v.strip()]
        occ.update(items)
        rec.update(set(items))
    mark = {k: "rare" if c < 3 else "common" if c > 0.3 * len(rows) else None for k, c in rec.items()}
    for most, detect in ((4096, 50_000), (2, 40), (0, 10)):
        got = {(r["item_kind"], r["item"]): (r["n_occurrences"], r["n_notes"], r["mark"]) for r in frequency.item_counts(df.withColumn("item", F.lit(1)), most, detect).collect()}
        assert got == {k: (occ[k], rec[k], mark[k]) for k in occ}
    assert frequency.item_counts(df.limit(0)).count() == 0
    assert {r["mark"] for r in frequency.marked_items(df).collect()} == {"rare", "common"}


def test_distinctive_terms(spark):
    rows, df = zipf_notes(spark, 120)
    docs = [(i, Counter(norm(t[0]) for t in ts or [] if t and t[0] is not None)) for i, ts, _ in rows]
    dfreq = Counter(w for _, c in docs for w in c)
    n, avg = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    want = {}
    for i, c in docs:
        dl = sum(c.values())
        for w, tf in c.items():
            want[i, w] = math.log(1 + (n - dfreq[w] + 0.5) / (dfreq[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    got = {(r["note_id"], r["term"]): r["score"] for r in distinct.distinctive_terms(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    found = {tuple(r) for r in distinct.characteristic_terms(df).collect()}
    assert found == {(i, w) for i, c in docs for w, tf in c.items() if tf >= 4 and dfreq[w] <= 5}
    assert distinct.distinctive_terms(df.limit(0)).count() == 0


# -- p6 ------------------------------------------------------------------------


def test_near_duplicates(spark):
    rnd = random.Random(9)
    base = [rnd.sample(range(5000), 40) for _ in range(12)]
    sets = []
    for b in base:
        for edits in (0, 0, 2, 4, 6, 8, 10):
            s = list(b)
            for _ in range(edits):
                s[rnd.randrange(40)] = rnd.randrange(5000)
            rnd.shuffle(s)
            sets.append([f"T{x} " for x in s])
    sets += [["one"], ["one "], [], None, ["one", "two"]]
    rows = [(i, terms(*s) if s is not None else None) for i, s in enumerate(sets)] + [(0, terms(*sets[0]))]
    df = spark.createDataFrame(rows, f"note_id long, terms {TERM}").withColumn("rep", F.lit(1)).withColumn("size", F.lit(2))
    norms = [(i, {norm(t) for t in s or []}) for i, s in enumerate(sets)]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(norms, 2) if a | b and len(a & b) * 100 >= 70 * len(a | b)}
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    groups = {r["note_id"]: r for r in neardup.near_duplicate_groups(df).collect()}
    assert groups.keys() == {i for i, s in norms if s}
    assert all(groups[i]["group_id"] == groups[j]["group_id"] for i, j in want) and groups[1]["class_id"] == 0
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_an_id_repeated_with_other_terms_keeps_its_classes_apart(spark):
    one, two = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]
    near = [*one[:9], "c"]
    rows = [(5, one), (5, two), (7, two), (8, one), (9, near), (5, near), (3, ["x", "y"]), (3, ["x", "y", "z", "w"]), (4, ["x", "y", "z"])]
    df = spark.createDataFrame([(i, terms(*t)) for i, t in rows], f"note_id long, terms {TERM}")
    want = set()
    for (i, a), (j, b) in itertools.permutations(rows, 2):
        a, b = set(a), set(b)
        if i < j and len(a & b) * 100 >= 70 * len(a | b):
            want.add((i, j))
    assert (7, 8) not in want and {(5, 7), (5, 8), (5, 9), (8, 9), (3, 4)} == want
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    groups = sorted(tuple(r) for r in neardup.near_duplicate_groups(df).collect())
    assert [g for g in groups if g[0] in (7, 8, 9)] == [(7, 5, 5, 0), (8, 5, 5, 1), (9, 5, 5, 1)]


def test_blocks_lose_no_pair(spark):
    s = spark.createDataFrame([(i, 10, [5]) for i in range(60)], "rep long, size int, bands array<long>")
    for block in (7, 1000):
        assert neardup.candidate_pairs(s, block).count() == 60 * 59 // 2


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**62), 2**62, 200)
    for shared in (200, 170, 140, 60):
        b = np.concatenate([a[:shared], rng.integers(-(2**62), 2**62, 200 - shared)])
        _, sk = neardup.sketch_rows(np.concatenate([a, b]), np.array([0, 200]))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in sk[0] ^ sk[1])
        j = shared / (400 - shared)
        assert abs(bits - neardup.most_differing_bits(j)) < 75


# -- p7, p8 ----------------------------------------------------------------------

TEXTS = [
    "Hello world, don't stop  \n\n\tnow 123 4567", "", None, " ", "\u00a0\u3000x", "漢字" * 400 + "かな", "a" * 3000, "-" * 1001, "é\u0301" * 400, "👩‍👩‍👧 🧭 ok",
    "<|endoftext|> is text", "deadbeef" * 200, "x\r\n\r\ny", "".join(random.Random(4).choice("abcdefghij") for _ in range(5000)),
]


def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), DOC).withColumn("ids", F.lit(0))
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder(tokens.load_vocabulary())
    first = [e([x])[0].tolist() for x in TEXTS if x]
    assert first == [e([x])[0].tolist() for x in TEXTS if x]


def test_merges_use_tokens_of_lower_rank():
    """What `merge_long` relies on."""
    with open(tokens.VOCABULARY, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    made = {}
    for rank, m in enumerate(merges):
        a, b = m.split(" ") if isinstance(m, str) else m
        assert made.get(a, -1) < rank and made.get(b, -1) < rank
        made[a + b] = rank


def test_closest_sum_is_optimal():
    rnd = random.Random(2)
    for _ in range(200):
        items = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        room = rnd.randint(1, 90)
        c = Counter(items)
        used = packing.closest_sum(sorted(c, reverse=True), [c[k] for k in sorted(c, reverse=True)], room)
        best = max(s for k in range(len(items) + 1) for x in itertools.combinations(items, k) if (s := sum(x)) <= room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= c[k] for k, n in used.items())


def test_packing(spark):
    rnd = random.Random(6)
    items = [(i, rnd.choice([0, 1, 3, 100, 101, 250, rnd.randint(1, 90)])) for i in range(400)] + [(7, 20), (7, 20)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").withColumn("part", F.lit(1))
    kinds = spark.createDataFrame([("s", 100), ("s", 100), ("l", 1000), ("null", None), ("zero", 0)], "container string, capacity int")
    for per in (20_000, 50):
        rows = packing.pack_items(df, kinds, per).collect()
        assert {r["container"] for r in rows} == {"s", "l"}
        for kind, cap in (("s", 100), ("l", 1000)):
            mine = [r for r in rows if r["container"] == kind]
            fill, size = Counter(), Counter()
            for r in mine:
                fill[r["bin"]] += r["n_tokens"]
                size[r["doc_id"]] += r["n_tokens"]
            want = Counter()
            for i, n in items:
                want[i] += n
            assert size == want and max(fill.values()) <= cap
            assert all(n <= cap for n in fill.values())
            parts = Counter((r["doc_id"]) for r in mine)
            assert all(parts[i] == max(1, -(-n // cap)) for i, n in items if i != 7)
            used = sum(1 for n in fill.values() if n)
            groups = -(-len(items) // per)
            assert used <= -(-sum(n for _, n in items) // cap) + 2 * groups
    assert packing.pack_items(df.limit(0), kinds).count() == 0 and packing.pack_items(df, kinds.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "word " * 3000)], DOC)
    got = packing.pack_documents(docs, spark.createDataFrame([("c", 512)], "container string, capacity int")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4} and max(r["n_tokens"] for r in got) == 512


# -- p9 ------------------------------------------------------------------------


def test_look_alikes(spark):
    base = "Recipe cafe\u0301 - office K"
    same = [base, "Recipe caf\u00e9 - office K", "Rec\u0456\u0440e caf\u00e9 \u2010 of\ufb01ce \u212a", "\uff32ecipe caf\u00e9\u00a0- o\u200bffice\u3000K", "\ufeffRecipe cafe\u0301\u00ad - office K"]
    other = ["recipe caf\u00e9 - office K", "Recipe cafe - office K", "Recipe caf\u00e9  - office K", "x\u00b2", "x2", "\u2460", "1", "\u0410", "A", "\U0001f469\u200d\U0001f467", "\U0001f469\U0001f467", "", " ", "\u200b", "\u200b\u200b", None]
    texts = same + other + [same[0], other[0]]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("look", F.lit(1)).withColumn("t1", F.lit(2))
    m = len(same)
    first = len(same) + len(other)
    cls = [*range(m), first]
    want = {(a, b) for a, b in itertools.combinations(cls, 2) if texts[a] != texts[b]} | {(m + 7, m + 8)}
    assert {tuple(r) for r in lookalike.look_alike_pairs(df).collect()} == want
    forms = {r["doc_id"]: r["form"] for r in lookalike.canonical_forms(df).collect()}
    assert len(forms) == len(texts) and {forms[i] for i in cls} == {"Recipe caf\u00e9 - office K"} and forms[m + 15] is None
    assert forms[m] == texts[m] and forms[m + 7] == forms[m + 8] == "A"
    assert lookalike.look_alike_pairs(df.limit(0)).count() == 0


def test_what_collation_holds_equal_stays_apart(spark):
    england, scotland = ("\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in f"gb{n}") + "\U000e007f" for n in ("eng", "sct"))
    texts = ["room 5", "room \u0665", "room \u096b", f"x {england}", f"x {scotland}", "a\u0316", "a\u0317", "\U0001d400 b", "\U0001d434 b"]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    look = df.select(F.collate(lookalike.mapped(F.col("text")), "UNICODE").alias("x"))
    assert look.distinct().count() < len(texts)  # the collation alone would take them for equal
    assert lookalike.look_alike_pairs(df).count() == 0


def test_scripts_have_fingerprints_and_large_classes_blocks(spark):
    alone = ["\u0e01\u0e02", "\u0e04\u0e05", "\u0645\u0631\u062d", "\u0634\u0643\u0631", "\u05d0\u05d1", "\u05d2\u05d3"]
    hashes = lookalike.text_hashes(spark.createDataFrame(list(enumerate(alone)), DOC))
    assert hashes.select("fp").distinct().count() == len(alone)
    forms = ["\u304b\u3099\u304b", "\u304c\u304b", "\u0624\u0645", "\u0648\u0654\u0645", "\U0002f800 x", "\u4e3d x", "\u1fef y", "` y"]
    df = spark.createDataFrame(list(enumerate(forms)), DOC)
    assert {tuple(r) for r in lookalike.look_alike_pairs(df).collect()} == {(i, i + 1) for i in range(0, len(forms), 2)}
    many = [(i, "office" if i % 3 else "o\ufb01ce".replace("\ufb01", "f\ufb01")) for i in range(60)] + [(60, None), (None, "office"), (5, "other")]
    df = spark.createDataFrame(many, DOC)
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if (a % 3 == 0) != (b % 3 == 0)}
    for block in (7, 2000):
        assert {tuple(r) for r in lookalike.look_alike_pairs(df, block).collect()} == want
    rows = lookalike.canonical_forms(df).collect()
    assert len(rows) == len(many) and Counter(r["form"] for r in rows) == {"office": 61, None: 1, "other": 1}


def test_single_characters_are_stable():
    old, new = lookalike.single_characters()
    pairs = dict(zip(old, new))
    assert len(set(old)) == len(old) and pairs["\uff21"] == "A" and pairs["\u212a"] == "K" and pairs["\u2007"] == " "
    assert all(unicodedata.normalize("NFC", v) not in pairs or pairs[v] == v for v in pairs.values())
    assert "\u200d" in old[len(new) :] and "a" not in pairs


def test_composed_and_decomposed_texts_look_alike(spark):
    nfc, nfd = (lambda x, form=form: unicodedata.normalize(form, x) for form in ("NFC", "NFD"))
    chars = [c for c in map(chr, range(0x30000)) if unicodedata.decomposition(c)[:1] not in ("", "<")]
    rows = [(i, x) for i, c in enumerate(chars) for x in (f"x{c}y", nfd(f"x{c}y"))]
    got = spark.createDataFrame(rows, DOC).select("doc_id", lookalike.mapped(F.col("text")).alias("look")).collect()
    forms = {}
    for r in got:
        forms.setdefault(r["doc_id"], set()).add(nfc(r["look"]))
    assert [hex(ord(chars[i])) for i, f in forms.items() if len(f) > 1] == []
    words = ["\u03a0\u03cc\u03bb\u03b7", "\u040e\u0441\u0451 \u045e", "\u0386\u0388\u038a\u038c", "\u040c\u0450", "a \u2224 b", "\u1f44\u1f88"]
    texts = [t for w in words for t in (w, nfd(w))]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    assert {tuple(r) for r in lookalike.look_alike_pairs(df).collect()} == {(i, i + 1) for i in range(0, len(texts), 2)}
