"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: texts are cut into words; the distinct words of a batch become padded numpy matrices, one per
length bucket, in which every row merges its leftmost pair of minimum rank each round. Pairs are looked up
in an open-addressing hash table; after each round rows are compacted and finished rows leave the matrix.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..common import spread

#: Where the public vocabulary lies; a parameter of every operator here. The file is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: How this family of vocabularies cuts a text into words (fixed value, part of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(-1)
#: Words of more bytes are merged one by one, all repeats of the minimum pair in one round.
LONG_WORD = 256
#: Cells of one matrix, and distinct words a task remembers before it starts afresh.
CELLS, REMEMBERED = 1 << 21, 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Numpy tables of fixed size (about 6 MB), broadcast to the tasks."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    probes: int

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting id of each pair; rank `_NONE` where there is no such merge."""
        key = (a.astype(np.int64) << 20) | b
        at = _slot(key, len(self.keys))
        rank, new = np.full(key.shape, _NONE), np.zeros(key.shape, np.int32)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key
            rank[hit], new[hit] = self.ranks[at[hit]], self.merged[at[hit]]
            if (hit | (held == _EMPTY)).all():
                break
            at = (at + 1) & (len(self.keys) - 1)
        return rank, new


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files: itself, or the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Build the tables on the driver from the file's vocabulary and merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], byte_letters()
    byte_ids = np.zeros(256, np.int32)
    for letter, byte in letters.items():
        byte_ids[byte] = vocab[letter]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    a = np.array([vocab[x] for x, _ in pairs], np.int64)
    b = np.array([vocab[y] for _, y in pairs], np.int64)
    new = np.array([vocab[x + y] for x, y in pairs], np.int32)
    size = 1 << max(8, int(len(pairs) * 3).bit_length())
    key = (a << 20) | b
    keys, ranks, merged = np.full(size, _EMPTY), np.full(size, _NONE), np.zeros(size, np.int32)
    probes, todo, at = 1, np.arange(len(pairs)), _slot(key, size)
    while len(todo):  # all pairs probe at once; of those that want one free slot the first gets it
        free = keys[at] == _EMPTY
        want, first = np.unique(at[free], return_index=True)
        won = todo[free][first]
        keys[want], ranks[want], merged[want] = key[won], won, new[won]
        rest = ~np.isin(todo, won)
        todo, at = todo[rest], (at[rest] + 1) & (size - 1)
        probes += 1
    return Vocabulary(byte_ids, keys, ranks, merged, probes)


def merge_matrix(v: Vocabulary, m: np.ndarray) -> list[np.ndarray]:
    """Token ids of every row of `m`, a matrix of byte ids padded with -1."""
    out: list[np.ndarray] = [None] * len(m)  # type: ignore[list-item]
    rows = np.arange(len(m))

    def ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, new = v.rank(np.maximum(a, 0), np.maximum(b, 0))
        rank[(a < 0) | (b < 0)] = _NONE
        return rank, new

    rank, new = ranked(m[:, :-1], m[:, 1:])
    while len(rows):
        width = m.shape[1]
        if width > 1:
            j = rank.argmin(1)
            each = np.arange(len(rows))
            alive = rank[each, j] != _NONE
        else:
            alive = np.zeros(len(rows), bool)
        if not alive.all():
            for r, ids in zip(rows[~alive], m[~alive]):
                out[r] = ids[ids >= 0]
            if not alive.any():
                break
            rows, m, rank, new, j = rows[alive], m[alive], rank[alive], new[alive], j[alive]
            each = np.arange(len(rows))
        m[each, j] = new[each, j]
        take = np.arange(width - 1)
        m = np.take_along_axis(m, take + (take > j[:, None]), 1)
        if width == 2:
            rank, new = rank[:, :0], new[:, :0]
            continue
        take = np.arange(width - 2)
        at = take + (take > j[:, None])
        rank, new = np.take_along_axis(rank, at, 1), np.take_along_axis(new, at, 1)
        for near in (j - 1, j):
            ok = (near >= 0) & (near < width - 2)
            e, p = each[ok], near[ok]
            rank[e, p], new[e, p] = ranked(m[e, p], m[e, p + 1])
    return out


def merge_long(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Token ids of one long word.

    A merge only uses tokens made by merges of lower rank, so merging all non-overlapping repeats of the
    minimum pair, from the left, gives what one merge a round gives.
    """
    rank, new = v.rank(ids[:-1], ids[1:])
    while len(ids) > 1:
        low = rank.min()
        if low == _NONE:
            break
        at = np.flatnonzero(rank == low)
        run = np.cumsum(np.append(True, np.diff(at) != 1))  # overlapping repeats, as in aaaa, come in runs
        at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
        ids[at] = new[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        place = (np.cumsum(keep) - 1)[at]
        ids = ids[keep]
        rank, new = np.delete(rank, at), np.delete(new, at)
        near = np.unique(np.concatenate([place - 1, place]))
        near = near[(near >= 0) & (near < len(ids) - 1)]
        rank[near], new[near] = v.rank(ids[near], ids[near + 1])
    return ids


def encode_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of each non-empty word, by matrices of words of similar length."""
    out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        if longest > LONG_WORD:
            out[order[at]] = merge_long(v, v.byte_ids[np.frombuffer(words[order[at]], np.uint8)].copy())
            at += 1
            continue
        width = int(max(4, longest + longest // 4))
        end = min(int(np.searchsorted(lengths[order], width, "right")), at + max(1, CELLS // width))
        part = order[at:end]
        flat = v.byte_ids[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
        n = lengths[part]
        m = np.full((len(part), n[-1]), -1, np.int32)
        m[np.arange(n[-1]) < n[:, None]] = flat
        for i, ids in zip(part, merge_matrix(v, m)):
            out[i] = ids
        at = end
    return out


class Encoder:
    """Encodes batches of texts and remembers the words it has met."""

    def __init__(self, v: Vocabulary):
        import regex

        self.v, self.cut = v, regex.compile(WORDS).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the `len(texts) + 1` offsets; null and empty texts have none."""
        if len(self.index) > REMEMBERED:
            self.forget()
        words = [self.cut(t) if t else [] for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self.index})
        if fresh:
            ids = encode_words(self.v, [w.encode("utf-8") for w in fresh])
            known = len(self.index)
            self.index.update((w, known + i) for i, w in enumerate(fresh))
            self.flat = np.concatenate([self.flat, *ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])
        at = np.fromiter((self.index[w] for ws in words for w in ws), np.int64)
        n = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)]
        counts = np.cumsum([len(ws) for ws in words])
        return ids, np.append(0, np.append(0, ends)[counts])


def _encoded(vocabulary, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, offsets = encode(part.column(1).to_pylist())
                made = pa.array(np.diff(offsets)) if counts_only else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["doc_id", "x"])

    return run


def token_ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`(doc_id, ids)`: ids without special tokens, whose strings are ordinary text; one row per row of documents.

    Null and empty texts give an empty list, blank ones the tokens of their blanks. Whole texts are
    encoded; nothing is shuffled, but inputs of fewer partitions than cores are spread over these first.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    return spread(documents.select("doc_id", "text")).mapInArrow(_encoded(shared, False), "doc_id long, x array<int>").withColumnRenamed("x", "ids")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`(doc_id, n_tokens)`, 0 for null and empty texts."""
    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    return spread(documents.select("doc_id", "text")).mapInArrow(_encoded(shared, True), "doc_id long, x long").withColumnRenamed("x", "n_tokens")
