import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notemill import reference_queries
from notemill.operators import attrs, index, search
from notemill.errors import UsageError

DOCS = [("alpha beta", "draft", "apollo"), ("alpha", "draft", "zeta"), ("alpha alpha", "final", "apollo"), ("beta gamma", "final", "zeta"), ("gamma", "draft", "apollo")]
ALL = ["alpha", "beta", "gamma"]


@pytest.fixture(scope="module")
def world(spark):
    rows = [(i, f"notes/doc-{i}.md", [(w, "body") for w in t.split()], {"status": [s], "project": [p]}) for i, (t, s, p) in enumerate(DOCS)]
    notes = spark.createDataFrame(rows, "note_id long, path string, terms array<struct<term:string,field:string>>, attributes map<string,array<string>>")
    notes = notes.withColumn("title", F.lit("t"))
    terms = index.indexed_terms(notes)
    posted = index.postings(terms).cache()
    docs = search.searchable_documents(notes, index.doc_lengths(notes.select(F.col("note_id").alias("doc_id")), terms)).cache()
    return posted, docs, index.attributes(notes, "note_id").cache()


def run(world, **kw):
    q = search.SearchQuery(**kw)
    return search.search(*world, q, 5, 1.6).orderBy("rank").collect()


@pytest.mark.parametrize(
    "kw, ids",
    [
        ({"terms": ["beta"]}, [0, 3]),
        ({"terms": ["alpha"]}, [2, 1, 0]),
        ({"terms": ALL, "filters": {"project": ["zeta"]}}, {1, 3}),
        ({"terms": ALL, "filters": {"status": ["draft"], "project": ["apollo"]}}, {0, 4}),
        ({"terms": ALL, "filters": {"project": ["apollo", " Zeta "], "STATUS": ["final"]}}, {2, 3}),
        ({"terms": ["alpha"], "filters": {"status": ["archived"]}}, []),
        ({"terms": ALL, "not_filters": {"status": ["draft"]}}, {2, 3}),
        ({"terms": ALL, "path_prefix": "notes/doc-0"}, {0}),
        ({"terms": [], "filters": {"status": ["draft"]}}, []),
        ({"terms": ALL, "limit": 0}, []),
        ({"terms": ALL, "limit": -3}, []),
    ],
)
def test_search(world, kw, ids):
    got = [r["doc_id"] for r in run(world, **kw)]
    assert (set(got) if isinstance(ids, set) else got) == ids


def test_matched_terms_and_limit(world):
    assert len(run(world, terms=ALL, limit=2)) == 2
    assert all(r["matched_terms"] == ["alpha"] for r in run(world, terms=["alpha", "nothing", "alpha"]))


@pytest.mark.parametrize("tf, df, n, length, avg, want", [
    (3, 2, 10, 50, 40, math.log(4.4) * 6.6 / (3 + 1.2 * 1.1875)),
    (4, 5, 100, 30, 30, math.log(1 + 95.5 / 5.5) * 8.8 / 5.2),
    (2, 3, 20, 999, 0, math.log(1 + 17.5 / 3.5) * 4.4 / 3.2),
    (2, 3, 20, 999, -5, math.log(1 + 17.5 / 3.5) * 4.4 / 3.2),
])
def test_score(spark, tf, df, n, length, avg, want):
    s = search.term_score(F.lit(tf), F.lit(df), F.lit(length), n, avg)
    assert spark.range(1).select(s.alias("s")).first()["s"] == pytest.approx(want, abs=1e-12)


def test_filters_of_strings():
    assert search.parse_filters(["a=b=c", "a=d"], ["t"]) == {"a": ["b=c", "d"], "tags": ["t"]}
    with pytest.raises(UsageError):
        search.parse_filters(["novalue"])
    assert search.build_query(["x"], limit="many").limit == 10


def test_similar_leaves_itself_out(spark, world):
    posted, docs, _ = world
    got = search.similar(["alpha", "beta", "zzz"], 0, posted, docs, 5, 1.6).orderBy("rank").collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3}
    assert search.similar([], 0, posted, docs, 5, 1.6).count() == 0


def test_census(spark):
    rows = [(1, "type", "note"), (2, "type", "note"), (3, "type", "question")] + [(i, "tags", t) for i in (1, 2, 3) for t in ("alpha", "beta")]
    a = spark.createDataFrame(rows, "doc_id long, key string, value string")
    got = {(r["key"], r["value"]): r["doc_count"] for r in attrs.census(a).collect()}
    assert got == {("tags", "alpha"): 3, ("tags", "beta"): 3, ("type", "note"): 2, ("type", "question"): 1}
    assert [r["value"] for r in attrs.values_of(a, "TYPE").collect()] == ["note", "question"]
    r = attrs.report(attrs.census(a), 1).collect()
    assert [(x["key"], x["occurrences"], x["truncated"], [v["value"] for v in x["values"]]) for x in r] == [("tags", 6, True, ["alpha"]), ("type", 3, True, ["note"])]
    assert attrs.census(a, spark.createDataFrame([(3,)], "doc_id long")).count() == 3


def test_field_terms_and_weights(spark):
    p = spark.createDataFrame([(1, "The Cats", ["feline"], ["Run"], ["area/Dogs"], "run running"), (2, None, None, None, None, None)],
                              "doc_id long, title string, aliases array<string>, headings array<string>, tags array<string>, body string")
    terms = index.field_terms(p)
    got = sorted((r["term"], r["field"]) for r in terms.collect())
    assert got == [("area", "tag"), ("area/dogs", "tag"), ("cat", "title"), ("dog", "tag"), ("felin", "alias"), ("run", "body"), ("run", "body"), ("run", "heading")]
    assert {(r["term"], r["wtf"]) for r in index.postings(terms).collect()} == {("area", 2), ("area/dogs", 2), ("cat", 3), ("dog", 2), ("felin", 3), ("run", 4)}
    half = index.postings(terms, {"heading": 0.5, "title": 0.1})
    assert {(r["term"], r["wtf"]) for r in half.where("term in ('run','cat')").collect()} == {("run", 3), ("cat", 1)}
    assert {(r["doc_id"], r["length"]) for r in index.doc_lengths(p, terms).collect()} == {(1, 8), (2, 0)}
    empty = index.corpus_stats(index.doc_lengths(p.limit(0), terms.limit(0)), index.postings(terms.limit(0))).first()
    assert (empty["doc_count"], empty["avg_length"]) == (0, 0.0)


TERMED = "note_id long, path string, terms array<struct<term:string,field:string>>"


def test_document_postings_are_postings_by_row(spark):
    rows = [(1, "b", [(" Cat", "title"), ("cat", "body"), (None, "body"), ("dog", "new"), ("dog", None), ("", "tag")]), (2, None, None), (3, "a", []), (4, "c", [None, ("\u00c4x", "heading")])]
    notes = spark.createDataFrame(rows, TERMED)
    got = index.document_postings(notes).collect()
    terms = index.indexed_terms(notes)
    flat = {(t, r["doc_id"], w) for r in got for t, w in zip(r["terms"], r["wtf"], strict=True)}
    assert flat == {tuple(r) for r in index.postings(terms).collect()} and len(flat) == sum(len(r["terms"]) for r in got) == 4
    assert {(r["doc_id"], r["length"]) for r in got} == {tuple(r) for r in index.doc_lengths(notes.select(F.col("note_id").alias("doc_id")), terms).collect()}
    assert {(r["doc_id"], r["path"]) for r in got} == {(1, "b"), (2, None), (3, "a"), (4, "c")}
    half = index.document_postings(notes, {"title": 0.5, "body": 1.0}).where("doc_id = 1").first()
    assert dict(zip(half["terms"], half["wtf"])) == {"cat": 2, "dog": 2, "": 2}


@pytest.mark.parametrize("limit, own, blocks", [
    (3, False, {}), (3, True, {}), (1, True, {"postings_per_block": 40}), (7, True, {"docs_per_block": 9, "asked_per_block": 6}),
    (500, False, {"asked_per_block": 11}), (0, False, {}), (-2, False, {}),
])
def test_batch_is_every_search_alone(spark, limit, own, blocks):
    """Few words, so that scores tie; ties go by path, a null one first, and then by id."""
    draw = random.Random(5)
    words = ["all", "", "\u00fcber", *"abcdefgh"]
    docs = {i: (draw.choice([None, "x", "Y", "\u00e9", "z/1"]), ["all"] + draw.choices(words, k=draw.randint(0, 4)) if i % 7 else []) for i in range(120)}
    asked = {i: {"all", *draw.choices([*words, "nowhere"], k=3)} if i % 4 else {"nowhere"} for i in range(0, 140, 2)}
    notes = spark.createDataFrame([(i, p, [(t, "body") for t in ts]) for i, (p, ts) in docs.items()], TERMED)
    queries = spark.createDataFrame([(q, 0, t) for q, ts in asked.items() for t in ts], "query_id long, pos int, term string")
    made = index.document_postings(notes).cache()
    df = index.document_frequency(made.select(F.explode("terms").alias("term")))
    avg = sum(len(ts) for _, ts in docs.values()) / len(docs)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["path"], r["score"]) for r in search.search_batch(queries, made, df, len(docs), avg, limit, own, **blocks).collect()}
    held = Counter(t for _, ts in docs.values() for t in set(ts))
    want = {}
    for q, ts in asked.items():
        sums = defaultdict(float)
        for d, (_, body) in docs.items():
            for t, wtf in Counter(body).items():
                if t in ts and not (own and d == q):
                    sums[d] += math.log(1 + (len(docs) - held[t] + 0.5) / (held[t] + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len(body) / avg))
        order = sorted((-round(s, 8), docs[d][0] is not None, (docs[d][0] or "").encode(), d) for d, s in sums.items())
        want |= {(q, k): (d, docs[d][0], -s) for k, (s, _, _, d) in enumerate(order[: max(0, limit)], 1)}
    assert got == want and (len(got) > 30 or limit < 1)


def test_batch_of_nothing(spark):
    notes = spark.createDataFrame([(20, "a", [("x", "title"), ("x", "body")]), (21, "b", None)], TERMED)
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in reference_queries._batch(notes).collect()] == [(20, 1, 20)]
    assert reference_queries._similar(notes).count() == 0
    for f in (reference_queries._batch, reference_queries._similar):
        assert f(notes.limit(0)).count() == f(notes.where("note_id = 21")).count() == 0


def shuffled_rows(df):
    """Rows that the exchanges of a query wrote, after it ran."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def alike(spark):
    """2,000 notes that all hold one word, 100 of which ask: 200,000 pairs."""
    held = "array(named_struct('term', 'all', 'field', 'title'), named_struct('term', 'all', 'field', 'body'), named_struct('term', 'w' || note_id, 'field', 'body'))"
    return spark.range(1, 2001).toDF("note_id").selectExpr("note_id", "'n' || note_id AS path", "'t' AS title", f"{held} AS terms")


def test_batch_moves_no_row_per_query_and_document(alike):
    found = reference_queries._batch(alike)
    assert 0 < shuffled_rows(found) < 40_000
    assert found.count() == 1000


def test_similar_batch_moves_no_row_per_query_and_document(alike):
    found = reference_queries._similar(alike)
    assert 0 < shuffled_rows(found) < 40_000
    assert found.count() == 1000 and found.where("query_id = doc_id").count() == 0


def test_batch_moves_no_block_once_per_block_of_the_other_side(spark, alike):
    """7 blocks of documents or more and 10 of queries: what the search shuffles at the end are hits, not 10 times the documents."""
    made = index.document_postings(alike).cache()
    df = index.document_frequency(made.select(F.explode("terms").alias("term")))
    queries = alike.where("note_id % 20 = 0").selectExpr("note_id AS query_id", "0 AS pos", "'all' AS term")
    found = search.search_batch(queries, made, df, 2000, 3.0, postings_per_block=600, asked_per_block=10)
    assert 0 < shuffled_rows(found) < 3_000
    # all score alike, so paths decide across blocks
    first = sorted((f"n{i}", i) for i in range(1, 2001))[:10]
    assert {(r["query_id"], r["rank"], r["path"], r["doc_id"]) for r in found.collect()} == {(q, k, *x) for q in range(20, 2001, 20) for k, x in enumerate(first, 1)}


@pytest.mark.parametrize("most, sizes", [((3, 99, 99), [3, 3, 1]), ((99, 5, 99), [2, 1, 3, 1]), ((99, 99, 4), [2, 1, 2, 2]), ((99, 99, 99), [7])])
def test_document_blocks_hold_every_document_once(most, sizes):
    """A document above a limit is a block of its own; documents come in the order of paths, postings by word."""
    terms = [["a"], ["b"], list("abcdef"), ["a", "b", "c", "d"], [], ["a"], ["c"]]
    docs = pa.record_batch({"doc_id": pa.array(range(7)), "path": pa.array([None, *"fedcba"]), "length": pa.array([9] * 7, pa.int32()), "terms": terms, "wtf": [[i + 1] * len(t) for i, t in enumerate(terms)]})
    got = [search._unpacked(x.as_py()) for t in search.document_blocks(iter([docs[:4], docs[4:]]), *most) for x in t.column("docs")]
    assert [len(x["doc_id"]) for x in got] == sizes
    flat = set()
    for x in got:
        assert (keys := [(p is not None, p or "") for p in x["path"].to_pylist()]) == sorted(keys)
        words = np.repeat(np.array(x["words"].to_pylist()), x["sizes"].to_numpy())
        flat |= {(x["doc_id"][a].as_py(), str(w), n) for w, a, n in zip(words, np.cumsum(x["steps"].to_numpy()), x["wtf"].to_pylist(), strict=True)}
    assert flat == {(i, w, i + 1) for i, t in enumerate(terms) for w in t}
