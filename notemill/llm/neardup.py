"""Near-duplicate records with small edits.

Method: odd sketches. MinHash samples of every distinct term set are cut into bands, whose collisions are
the candidates, and folded into parity bitmaps; the population count of the XOR of two bitmaps estimates
their similarity and verifies candidates, of which the survivors are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import block_pairs, cut, few, normalised, spread, stored
from ..operators.components import components

#: Share of the union that two term sets must share, in percent.
SIMILAR_PERCENT = 70
#: 80 bands of 5 samples: a pair at 0.7 collides in none of them with probability (1 - 0.7**5)**80 = 4e-7.
BANDS, ROWS = 80, 5
#: Bits of an odd sketch of the BANDS * ROWS samples.
SKETCH_BITS = 2048
#: Candidates whose estimate is below this are dropped; 0.7 is more than five standard deviations above.
SKETCH_LEAST = 0.45
#: Rows of a band bucket that meet in one join group; larger buckets are cut into blocks.
BLOCK = 2_000


def most_differing_bits(least: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """Expected XOR population count of the sketches of two sets with similarity `least`.

    `2 samples (1 - J)` elements differ; each flips one of `bits` parities.
    """
    return round(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - least))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_rows(hashes: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS):
    """Band keys `(n, bands)` and odd sketches `(n, bits / 64)` of n non-empty sets of 64-bit hashes.

    `hashes` has the sets one after the other, `starts` where each begins.
    """
    n, m = len(starts), bands * rows
    x = hashes.astype(np.uint64)
    rng = np.random.default_rng(20_240_229)
    mult = rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, m, dtype=np.uint64)
    keys = np.zeros((n, bands), np.uint64)
    parity = np.zeros((n, bits), np.uint8)
    at = np.arange(n)
    for j in range(m):
        least = np.minimum.reduceat((x * mult[j] + add[j]) >> np.uint64(24), starts)
        tagged = _mix(least + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))
        parity[at, tagged % np.uint64(bits)] ^= 1
        band = j // rows
        keys[:, band] = _mix(keys[:, band] ^ tagged)
    return keys.view(np.int64), np.packbits(parity, axis=1, bitorder="little").view(np.int64)


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):  # bounds the parity matrix
            part = batch.slice(at, 2000)
            lists = part.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            keys, sketch = sketch_rows(flat, offsets[:-1] - offsets[0])
            as_lists = lambda m: pa.ListArray.from_arrays(
                pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists, part.column(2), as_lists(keys), as_lists(sketch)], names=["rep", "terms", "size", "bands", "sketch"]
            )


def term_sets(notes: DataFrame) -> DataFrame:
    """`(note_id, terms, d1, d2)`: notes with terms; those without any are left out.

    terms has the sorted 64-bit hashes of the distinct normalised terms, all fields together, d1 and d2 are a 128-bit hash of
    them. Repeated terms go before they are normalised. Two terms with one hash would count as one.
    """
    raw = F.array_distinct(F.filter(F.col("terms.term"), lambda x: x.isNotNull()))
    hashes = F.sort_array(F.array_distinct(F.transform(raw, lambda x: F.xxhash64(normalised(x)))))
    rows = spread(notes.select("note_id", "terms")).select("note_id", F.explode(F.array(hashes)).alias("terms"))
    rows = rows.where(F.size("terms") > 0)
    return rows.select("note_id", "terms", F.xxhash64("terms").alias("d1"), F.xxhash64(F.lit(17), "terms", F.size("terms")).alias("d2"))


def classes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members `(note_id, rep, class_id, n)` and representatives `(rep, class_id, n, terms)`: notes with equal term sets are one class.

    class_id is the least note of the class, n counts its members. rep is the class's own number: an id repeated with other terms may be the
    least of several classes. Term sets are made once and stored; a third of all notes may be one class, so only ids and digests are aggregated,
    with partial minima, and the terms of one member of each class fetched afterwards.
    """
    sets = stored(term_sets(notes))
    ids = sets.select("note_id", "d1", "d2").distinct()
    least = ids.groupBy("d1", "d2").agg(F.min("note_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    reps = cut(least.withColumn("rep", F.monotonically_increasing_id()))  # written once, so the numbers stay
    copies = few(reps.where("n > 1"))
    copied = ids.join(copies, ["d1", "d2"]).select("note_id", "rep", "class_id", "n")
    single = reps.where("n = 1").select(F.col("class_id").alias("note_id"), "rep", "class_id", "n")
    own = few(reps).select("rep", "class_id", "n", F.col("d1").alias("r1"), F.col("d2").alias("r2"))
    mine = (F.col("note_id") == F.col("class_id")) & (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2"))
    held = sets.join(own, mine).select("rep", "class_id", "n", "terms").dropDuplicates(["rep"])  # of rows delivered twice
    return copied.union(single), held


def candidate_pairs(sketched: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(a, b)`, a < b, distinct: representatives that share a band and whose sizes allow the similarity.

    Buckets of two need no join. Larger buckets are joined with themselves, cut into blocks of about
    `block` rows where they are larger still: each pair of blocks is a join group of its own, so a bucket
    that holds a third of all rows is spread over many tasks, and the sizes are compared inside the join.
    No bucket is capped or dropped.
    """
    rows = sketched.select("rep", "size", F.explode("bands").alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("n > 1"))
    fits = lambda small, large: small * 100 >= large * SIMILAR_PERCENT
    twos = buckets.where("n = 2").select("a", "b")
    more = few(buckets.where("n > 2")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    inside = rows.join(more, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block i meets every block j >= i: the left copy stays in i for all j, the right copy goes to all i <= j
    left = inside.select("key", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), "rep", "size")
    right = inside.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), "rep", "size")
    l, r = left.alias("l"), right.alias("r")
    ordered = (F.col("l.i") != F.col("l.j")) | (F.col("l.rep") < F.col("r.rep"))
    small, large = F.least("l.size", "r.size"), F.greatest("l.size", "r.size")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    pairs = l.join(r, on & ordered & (F.col("l.rep") != F.col("r.rep")) & fits(small, large)).select(
        F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")
    )
    return twos.union(pairs).where("a <> b").distinct()


def similar_representatives(reps: DataFrame) -> DataFrame:
    """`(a, b)`: pairs of classes whose term sets share at least SIMILAR_PERCENT of their union."""
    hashed = reps.select("rep", "terms", F.size("terms").alias("size"))
    sketched = stored(spread(hashed).mapInArrow(_sketcher, "rep long, terms array<long>, size int, bands array<long>, sketch array<long>"))
    pairs = candidate_pairs(sketched.select("rep", "size", "bands"))
    bits = most_differing_bits(SKETCH_LEAST)

    def both(p: DataFrame, col: str) -> DataFrame:
        for end in ("a", "b"):
            p = p.join(sketched.select(F.col("rep").alias(end), F.col(col).alias(f"{col}_{end}")), end)
        return p

    differing = F.aggregate(
        F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x
    )
    verified = both(pairs, "sketch").where(differing <= bits).select("a", "b")
    exact = both(verified, "terms")
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    union = F.size("terms_a") + F.size("terms_b") - shared
    return exact.where(shared * 100 >= union * SIMILAR_PERCENT).select("a", "b").distinct()


def near_duplicate_pairs(notes: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(note_a, note_b)`, note_a < note_b, distinct: notes whose term sets share at least 70 percent of their union.

    Every pair of members of two similar classes, and of one class, is a case by definition; the pairs of
    members are made in blocks. `near_duplicate_groups` has the form that stays linear.
    Notes without terms are in no pair; a repeated row pairs with nothing of its own id, and an id repeated
    with other terms counts with each of its sets.
    """
    members, reps = classes(notes)
    members = cut(members)
    linked = similar_representatives(reps)
    sizes = members.select("rep", "n").distinct()
    for end in ("a", "b"):
        linked = linked.join(sizes.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}")), end)
    copied = sizes.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    pairs = block_pairs(cut(linked.select("a", "b", "n_a", "n_b").union(copied)), members.select(F.col("rep").alias("grp"), "note_id"), block)
    both = (F.col("a_note_id"), F.col("b_note_id"))
    return pairs.where(both[0] != both[1]).select(F.least(*both).alias("note_a"), F.greatest(*both).alias("note_b")).distinct()


def near_duplicate_groups(notes: DataFrame) -> DataFrame:
    """`(note_id, class_id, group_id, n_links)`: one row per note with terms.

    class_id is the least note with the same term set, group_id the least note reachable over pairs of
    similar classes, n_links the number of other classes that the note's class is similar to.
    """
    members, reps = classes(notes)
    linked = cut(similar_representatives(reps))
    groups = components(linked, "a", "b").select(F.col("id").alias("rep"), "component")
    named = members.select("rep", "class_id").distinct()
    groups = cut(groups.join(named, "rep"))
    groups = groups.select("rep", "component").join(groups.groupBy("component").agg(F.min("class_id").alias("group_id")), "component").drop("component")
    ends = linked.select(F.col("a").alias("rep")).union(linked.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    per_class = groups.join(degree, "rep")
    return members.join(per_class, "rep", "left").select(
        "note_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
