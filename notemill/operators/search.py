"""Ranked retrieval: field-weighted BM25 with attribute, tag and path filters, alone, in batches, and by example."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import cut, normalised, salted_join
from ..errors import UsageError

K1, B = 1.2, 0.75
#: Scores are compared and shown with so many digits, so that the order of a distributed sum never decides a rank.
DIGITS = 9
SIMILAR_TERMS = 20
#: What one task of `search_batch` holds: postings, about 60 bytes each while they are sorted; documents, 8 bytes each per query; terms of queries.
POSTINGS_PER_BLOCK, DOCS_PER_BLOCK, ASKED_PER_BLOCK = 3_000_000, 100_000, 1_000_000
BYTES_PER_BLOCK = 100_000_000  # of the postings' terms
#: Queries for which a task of their own is worth reading the documents once more.
QUERIES_PER_TASK = 256
#: Parts of a block's documents whose best sums bound the score of the last hit.
RUNS = 256


@dataclass
class SearchQuery:
    """A bag of analysed terms; filters are OR within a key and AND across keys as they are written."""

    terms: list[str]
    filters: dict[str, list[str]] = field(default_factory=dict)
    not_filters: dict[str, list[str]] = field(default_factory=dict)
    path_prefix: str | None = None
    limit: int = 10


def parse_filters(pairs: list[str], tags: list[str] | None = None) -> dict[str, list[str]]:
    """`key=value` strings on their first `=`, and tags, which are values of the key `tags`."""
    out: dict[str, list[str]] = {}
    for p in pairs:
        key, eq, value = p.partition("=")
        if not eq:
            raise UsageError(f"not key=value: {p}")
        out.setdefault(key, []).append(value)
    if tags:
        out.setdefault("tags", []).extend(tags)
    return out


def build_query(terms: list[str], filters=(), not_filters=(), tags=(), prefix: str | None = None, limit: str | int = 10) -> SearchQuery:
    try:
        n = int(limit)
    except ValueError:
        n = 10
    return SearchQuery(terms, parse_filters(list(filters), list(tags)), parse_filters(list(not_filters)), prefix, n)


def term_score(wtf: Column, df: Column, length: Column, n: float, avg: float, k1: float = K1, b: float = B) -> Column:
    """ln(1 + (N - df + .5) / (df + .5)) * wtf (k1 + 1) / (wtf + k1 norm); norm is 1 where the average is not positive."""
    norm = F.lit(1.0 - b) + F.lit(float(b)) * length / F.lit(float(avg)) if avg > 0 else F.lit(1.0)
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return idf * wtf * F.lit(k1 + 1.0) / (wtf + F.lit(float(k1)) * norm)


def _matching(attrs: DataFrame, key: str, values: list[str]) -> DataFrame:
    wanted = [v.strip().lower() for v in values]
    return attrs.where((F.col("key") == key.strip().lower()) & F.col("value").isin(wanted)).select("doc_id")


def allowed(docs: DataFrame, attrs: DataFrame | None, q: SearchQuery) -> DataFrame:
    """Documents that pass the filters: a semi join per key, an anti join per excluded key, a pushed-down prefix."""
    out = docs
    if q.path_prefix:
        out = out.where(F.col("path").startswith(q.path_prefix))
    for key, values in q.filters.items():
        out = out.join(_matching(attrs, key, values), "doc_id", "left_semi")
    for key, values in q.not_filters.items():
        out = out.join(_matching(attrs, key, values), "doc_id", "left_anti")
    return out


def score_documents(posted: DataFrame, docs: DataFrame, attrs: DataFrame | None, q: SearchQuery, n: float, avg: float, k1: float = K1, b: float = B) -> DataFrame:
    """`(doc_id, path, score, matched_terms)` of every document with a query term, before the limit.

    N, df and the average stay those of the whole collection, whatever the filters. Matched terms come in
    query order, in which the scores are added too.
    """
    terms = list(dict.fromkeys(q.terms))
    hit = posted.where(F.col("term").isin(terms)) if terms else posted.where(F.lit(False))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = F.array_position(F.array(*map(F.lit, terms or [""])), F.col("term"))
    rows = hit.join(F.broadcast(df), "term").join(allowed(docs, attrs, q).select("doc_id", "path", "length"), "doc_id")
    s = term_score(F.col("wtf"), F.col("df"), F.col("length"), n, avg, k1, b)
    # no more elements in a group than the query has terms
    got = F.array_sort(F.collect_list(F.struct(order.alias("pos"), s.alias("s"), F.col("term").alias("term"))))
    return rows.groupBy("doc_id", "path").agg(got.alias("got")).select(
        "doc_id",
        "path",
        F.round(F.aggregate("got", F.lit(0.0), lambda acc, x: acc + x["s"]), DIGITS).alias("score"),
        F.transform("got", lambda x: x["term"]).alias("matched_terms"),
    )


def search(posted: DataFrame, docs: DataFrame, attrs: DataFrame | None, q: SearchQuery, n: float, avg: float, k1: float = K1, b: float = B) -> DataFrame:
    """`(rank, doc_id, path, score, matched_terms)`: the best `limit` by score, then path, then id.

    No terms or a limit below 1 give no hits, even with filters.
    """
    scored = score_documents(posted, docs, attrs, q, n, avg, k1, b)
    top = scored.orderBy(F.desc("score"), "path", "doc_id").limit(max(0, q.limit))
    w = Window.orderBy(F.desc("score"), "path", "doc_id")  # over the few rows of the limit
    return top.select(F.row_number().over(w).alias("rank"), "doc_id", "path", "score", "matched_terms")


def query_terms(body_terms: DataFrame, df: DataFrame, n: float, most: int = SIMILAR_TERMS) -> DataFrame:
    """`(query_id, pos, term)`: per query document the `most` terms with the highest tf idf, then by term.

    Terms that no indexed document has are left out. `body_terms` is `(query_id, term)`, one row per occurrence.
    """
    tf = body_terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    scored = salted_join(tf, df, ["term"], "df").withColumn("s", F.round(F.col("tf") * idf, DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "term")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("query_id", "pos", "term")


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of different lengths as one compressed value."""
    row = pa.record_batch({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.Buffer) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(value).read_next_batch()
    return {k: row.column(k).flatten() for k in row.schema.names}


def _document_block(t: pa.Table) -> bytes:
    """Documents in the order of ties, by path, a null one first, then id; the postings of each word by its documents' places in that order."""
    by = pc.sort_indices(t, sort_keys=[("path", "ascending"), ("doc_id", "ascending")], null_placement="at_start")
    place = np.empty(len(by), np.int64)
    place[by.to_numpy()] = np.arange(len(by))
    lists = t.column("terms").combine_chunks()
    words = lists.flatten().dictionary_encode()
    key = words.indices.to_numpy() * np.int64(len(by)) + np.repeat(place, pc.list_value_length(lists).to_numpy())
    order = np.argsort(key)
    word, at = np.divmod(key[order], len(by)) if len(by) else (key, key)
    ordered = t.select(["doc_id", "path", "length"]).take(by)
    return _packed({k: ordered.column(k).combine_chunks() for k in ordered.column_names} | {
        "words": words.dictionary,
        "sizes": pa.array(np.bincount(word, minlength=len(words.dictionary)).astype(np.int32)),
        "steps": pa.array(np.diff(at, prepend=0).astype(np.int32)),  # from place to place: small numbers pack well
        "wtf": t.column("wtf").combine_chunks().flatten().take(pa.array(order)),
    })


def document_blocks(batches: Iterator[pa.RecordBatch], docs: int, postings: int, size: int) -> Iterator[pa.RecordBatch]:
    """One packed value per block of at most so many documents, postings and bytes of words; a document above them is a block of its own."""
    most, full, held = np.array([docs, postings, size]), np.zeros(3, np.int64), []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch({"docs": pa.array([_document_block(pa.Table.from_batches(held))], pa.binary())})
        held.clear()
        full[:] = 0
        return out

    for t in batches:
        ends = np.append(0, np.cumsum(pc.list_value_length(t.column("terms")).to_numpy(), dtype=np.int64))
        width = np.append(0, np.cumsum(pc.binary_length(t.column("terms").flatten()).to_numpy(), dtype=np.int64))
        ends = [np.arange(len(t) + 1), ends, width[ends]]
        begin = 0
        while begin < len(t):
            end = min(int(np.searchsorted(e, e[begin] + m - f, "right")) - 1 for e, m, f in zip(ends, most, full))
            if end <= begin and held:
                yield flush()
                continue
            end = max(end, begin + 1)
            held.append(t.slice(begin, end - begin))
            full += [e[end] - e[begin] for e in ends]
            begin = end
    if held:
        yield flush()


def _asked_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All queries of a partition as one packed value."""
    if held := [t for t in batches if len(t)]:
        t = pa.Table.from_batches(held).combine_chunks()
        words = t.column("terms").combine_chunks().flatten().dictionary_encode()
        df = np.zeros(len(words.dictionary), np.int64)
        df[words.indices.to_numpy()] = t.column("df").combine_chunks().flatten().to_numpy()
        sizes = pc.list_value_length(t.column("terms").combine_chunks())
        got = {"query_id": t.column("query_id").combine_chunks(), "sizes": sizes, "code": words.indices, "words": words.dictionary, "df": pa.array(df)}
        yield pa.record_batch({"asked": pa.array([_packed(got)], pa.binary())})


class _Best:
    """The best `limit` hits so far of each query of a block, by score, path, id, while blocks of documents pass by."""

    def __init__(self, asked: pa.Buffer, limit: int, exclude_self: bool, n: float, avg: float, k1: float, b: float):
        got = _unpacked(asked)
        self.ids, self.words, self.code = got["query_id"], got["words"], got["code"].to_numpy()
        self.ends = np.cumsum(got["sizes"].to_numpy()).tolist()
        df = got["df"].to_numpy()
        self.idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
        self.limit, self.exclude_self, self.avg, self.k1, self.b = limit, exclude_self, avg, k1, b
        self.bound = np.zeros(len(self.ids))  # the score of the last hit, once there are `limit`
        self.hits: pa.Table | None = None

    def meet(self, packed: pa.Buffer) -> None:
        """One dense row of sums is filled and read per query, so a pair of a query and a document is never a row."""
        docs, limit = _unpacked(packed), self.limit
        here = pc.index_in(self.words, value_set=docs["words"])
        there, here = np.flatnonzero(here.is_valid().to_numpy(zero_copy_only=False)), here.drop_null().to_numpy()
        sizes = docs["sizes"].to_numpy()
        first = np.append(0, np.cumsum(sizes, dtype=np.int64))
        begins, stops = np.zeros((2, len(self.words)), np.int64)
        begins[there], stops[there] = first[here], first[here + 1]
        begins, stops = begins.tolist(), stops.tolist()
        idf = np.zeros(len(sizes))
        idf[here] = self.idf[there]

        length = docs["length"].to_numpy()
        norm = (1.0 - self.b) + self.b * length / self.avg if self.avg > 0 else np.ones(len(length))
        at = np.cumsum(docs["steps"].to_numpy(), dtype=np.int64)
        wtf = docs["wtf"].to_numpy()
        share = np.repeat(idf, sizes)
        share *= wtf
        share *= self.k1 + 1.0
        below = (self.k1 * norm)[at]
        below += wtf
        share /= below
        del below, wtf

        own = np.full(len(self.ids), -1)
        if self.exclude_self:
            ids = docs["doc_id"]
            own = pc.fill_null(pc.index_in(self.ids.cast(ids.type), value_set=ids), -1).to_numpy()
        runs = min(len(length), max(RUNS, limit))
        sums = np.zeros(runs * -(-len(length) // runs))
        one = 10.0 ** (DIGITS - 1)
        count, found, scores = np.zeros(len(self.ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, (begin, end) in enumerate(zip([0, *self.ends], self.ends)):
            terms = [(begins[c], stops[c]) for c in self.code[begin:end].tolist() if stops[c]]
            if not terms:
                continue
            sums.fill(0.0)
            for f, t in terms:
                sums[at[f:t]] += share[f:t]  # a term has a document once
            if own[i] >= 0:
                sums[own[i]] = 0.0
            # as many runs have a document of at least this sum as there are places to fill; what rounding may lift to it stays
            least = self.bound[i]
            if not least and runs >= limit:
                least = np.partition(sums.reshape(runs, -1).max(axis=1), runs - limit)[runs - limit]
            hits = np.flatnonzero(sums >= least - 2 / one) if least > 2 / one else np.flatnonzero(sums)
            score = np.floor(sums[hits] * one + 0.5) / one
            if len(hits) > limit:
                last = np.partition(score, len(hits) - limit)[len(hits) - limit]
                more = np.flatnonzero(score > last)
                keep = np.append(more, np.flatnonzero(score == last)[: limit - len(more)])
                hits, score = hits[keep], score[keep]
            count[i] = len(hits)
            found.append(hits)
            scores.append(score)
        new = pa.array(np.concatenate(found))
        new = pa.table({"q": np.repeat(np.arange(len(count)), count), "doc_id": docs["doc_id"].take(new), "path": docs["path"].take(new), "score": np.concatenate(scores)})
        self._add(new)

    def _add(self, new: pa.Table) -> None:
        both = pa.concat_tables([self.hits, new] if self.hits else [new]).combine_chunks()
        keys = [("q", "ascending"), ("score", "descending"), ("path", "ascending"), ("doc_id", "ascending")]
        order = pc.sort_indices(both, sort_keys=keys, null_placement="at_start").to_numpy()
        q, score = both.column("q").to_numpy()[order], both.column("score").to_numpy()[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.limit - 1
        self.bound[q[last]] = score[last]
        self.hits = both.take(pa.array(order[rank < self.limit]))

    def rows(self) -> pa.Table:
        return pa.table({"query_id": self.ids.take(self.hits.column("q").combine_chunks()), **{k: self.hits.column(k) for k in ("doc_id", "path", "score")}})


def best_of_blocks(pairs: Iterator[pa.RecordBatch], *of) -> Iterator[pa.RecordBatch]:
    """`(query_id, doc_id, path, score)`: the best hits for each block of queries among all blocks of documents that come with it."""
    best: dict[bytes, _Best] = {}  # of one block of queries, where a partition holds one
    for t in pairs:
        for docs, asked in zip(t.column("docs"), t.column("asked")):
            key = hashlib.blake2b(asked.as_buffer(), digest_size=16).digest()
            if key not in best:
                best[key] = _Best(asked.as_buffer(), *of)
            best[key].meet(docs.as_buffer())
    for x in best.values():
        yield from x.rows().combine_chunks().to_batches()


def search_batch(
    queries: DataFrame, indexed: DataFrame, df: DataFrame, n: float, avg: float, limit: int = 10, exclude_self: bool = False, k1: float = K1, b: float = B,
    postings_per_block: int = POSTINGS_PER_BLOCK, docs_per_block: int = DOCS_PER_BLOCK, asked_per_block: int = ASKED_PER_BLOCK,
) -> DataFrame:
    """`(query_id, rank, doc_id, path, score)`: many queries `(query_id, pos, term)` in one job; a limit below 1 gives no hits.

    `indexed` is `index.document_postings`, with one row per document, and `df` `(term, df)` over it. Documents where they are, and queries by a hash, are
    packed into blocks that are written once; every block of documents meets every block of queries in memory, read from where it lies. A task takes one
    block of queries past its blocks of documents and gives `limit` hits per query; it takes all of them where the blocks of queries are enough for the
    cores. So what is written grows with documents and queries, never with their product. The sizes of blocks bound a task's memory and change no row.
    """
    limit = max(0, limit)
    terms = queries.select("query_id", "term").distinct().join(df, "term").select("query_id", F.struct("term", "df").alias("t"))
    # no more elements in a group than the query has terms, sorted, so that sums are always added in one order
    asked = cut(terms.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.df").alias("df")))
    n_queries, n_asked = asked.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    tasks = 2 * indexed.sparkSession.sparkContext.defaultParallelism
    rows = max(1, -(-(n_asked or 0) // asked_per_block), min(tasks, n_queries // QUERIES_PER_TASK))
    kind = lambda side, c: side.schema[c].dataType.simpleString()
    by = F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")
    left = indexed.select("doc_id", "path", "length", "terms", "wtf").mapInArrow(lambda t: document_blocks(t, docs_per_block, postings_per_block, BYTES_PER_BLOCK), "docs binary")
    right = cut(asked.repartitionById(rows, by).mapInArrow(_asked_block, "asked binary"))
    # a cartesian product reads its sides again and shuffles neither
    pairs = cut(left).coalesce(-(-tasks // rows)).crossJoin(right.hint("shuffle_replicate_nl"))
    of = limit, exclude_self, float(n), float(avg), k1, b
    schema = f"query_id {kind(asked, 'query_id')}, doc_id {kind(indexed, 'doc_id')}, path string, score double"
    found = pairs.where(F.lit(limit > 0)).mapInArrow(lambda t: best_of_blocks(t, *of), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "path", "score")


def similar(source_terms: list[str], self_id, posted: DataFrame, docs: DataFrame, n: float, avg: float, limit: int = 10, path_prefix: str | None = None) -> DataFrame:
    """The notes most like one with these body terms (one element per occurrence), itself left out."""
    spark = posted.sparkSession
    if not source_terms or limit <= 0:
        return search(posted, docs, None, SearchQuery([], limit=0), n, avg)
    body = spark.createDataFrame([(0, t) for t in source_terms], "query_id int, term string")
    df = posted.where(F.col("term").isin(list(set(source_terms)))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = [r["term"] for r in query_terms(body, df, n).orderBy("pos").collect()]  # at most SIMILAR_TERMS
    others = docs.where(F.col("doc_id") != F.lit(self_id))
    return search(posted, others, None, SearchQuery(terms, path_prefix=path_prefix, limit=limit), n, avg)


def searchable_documents(notes: DataFrame, lengths: DataFrame) -> DataFrame:
    """`(doc_id, path, length, title)` of notes that carry their terms."""
    return notes.select(F.col("note_id").alias("doc_id"), "path", "title").join(lengths, "doc_id")


def title_terms(notes: DataFrame) -> DataFrame:
    """`(query_id, pos, term)`: each note's distinct title terms as a query."""
    rows = notes.select(F.col("note_id").alias("query_id"), F.posexplode("terms").alias("p", "t")).where((F.col("t.field") == "title") & F.col("t.term").isNotNull())
    return rows.groupBy("query_id", normalised("t.term").alias("term")).agg(F.min("p").alias("pos")).select("query_id", "pos", "term")
