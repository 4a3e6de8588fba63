"""Filling fixed-capacity containers with items.

Method: minimum bin slack. A container begins with the longest item left; a subset-sum dynamic programme on
bitsets then picks, from the multiset of remaining lengths, the counts that come closest to the capacity,
and backtracking through the bitsets gives these counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut
from .tokens import VOCABULARY, token_counts

#: Items that one task packs together. Each group leaves at most its last containers part empty.
ITEMS_PER_GROUP = 20_000
#: Groups, of one kind of container each, that a task packs one after the other.
GROUPS_PER_TASK = 2

_OUT = "container string, capacity int, bin long, doc_id long, part int, start long, n_tokens int"


def closest_sum(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as close below `room` as can be.

    Bit s of a bitset says that s can be reached. Counts are split into powers of two, so a length costs
    log(count) shifts; the search ends as soon as `room` itself is reached.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in zip(lengths, counts):
        left, k = min(count, room // length), 1
        while left > 0:
            k = min(k, left)
            now = (reach | (reach << (k * length))) & full
            if now != reach:
                steps.append((length, k, reach))
                reach = now
            left -= k
            k *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return used


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container ordinal of every item; lengths are between 1 and `capacity`."""
    out = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes, first, count = np.unique(-lengths[order], return_index=True, return_counts=True)
    sizes = (-sizes).tolist()  # descending
    nxt, left = dict(zip(sizes, first.tolist())), dict(zip(sizes, count.tolist()))
    bin_ = 0
    while left:
        longest = next(iter(left))
        take = {longest: 1}
        left[longest] -= 1
        room = capacity - longest
        if room > 0:
            for n, k in closest_sum([s for s in left if s <= room and left[s]], [c for s, c in left.items() if s <= room and c], room).items():
                take[n] = take.get(n, 0) + k
                left[n] -= k
        for n, k in take.items():
            out[order[nxt[n] : nxt[n] + k]] = bin_
            nxt[n] += k
            if not left[n]:
                del left[n]
        bin_ += 1
    return out


def _pack_group(t: pa.Table) -> pa.Table:
    t = t.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
    capacity, group = t.column("capacity")[0].as_py(), t.column("grp")[0].as_py()
    n, doc = t.column("n_tokens").to_numpy(), t.column("doc_id")
    # a text above the capacity gives full containers of its own and its rest as an item
    whole = n // capacity if capacity else np.zeros(len(n), np.int64)
    pieces = np.maximum(whole + (n % capacity > 0), 1)
    at = np.repeat(np.arange(len(n)), pieces)
    part = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.where(part < whole[at], capacity, n[at] - whole[at] * capacity)
    bins = np.zeros(len(at), np.int64)
    items = np.flatnonzero(size > 0)
    bins[items] = pack_lengths(size[items], capacity)  # texts without tokens stay in container 0 of the group
    return pa.table(
        {
            "container": pa.array([t.column("container")[0].as_py()] * len(at), pa.string()),
            "capacity": np.full(len(at), capacity, np.int32),
            "bin": (np.int64(group) << 32) + bins,
            "doc_id": doc.take(pa.array(at)),
            "part": part.astype(np.int32),
            "start": (part * capacity).astype(np.int64),
            "n_tokens": size.astype(np.int32),
        }
    )


def pack_items(items: DataFrame, containers: DataFrame, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """Assign items `(doc_id, n_tokens)` to containers of each capacity.

    `(container, capacity, bin, doc_id, part, start, n_tokens)`: one row per container kind and item, or per
    part where an item alone exceeds the capacity (part counts from 0, start is its first token). Only ids
    and sizes are shuffled. Items are spread by a hash of their id and size over groups of about
    `items_per_group`; nothing is dropped. Items without tokens lie in container 0 of their group. Kinds
    with null or non-positive capacity hold nothing. Few kinds are assumed: their number multiplies the items.
    """
    groups = max(1, -(-items.count() // items_per_group))
    listed = containers.where(F.col("capacity") > 0).select("container", "capacity").distinct().collect()  # kinds, not items
    spread = items.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups)).cast("int").alias("grp"))
    if not listed:
        return items.sparkSession.createDataFrame([], _OUT)
    each = F.explode(F.array(*(F.struct(F.lit(k["container"]).alias("container"), F.lit(k["capacity"]).alias("capacity")) for k in listed)))
    rows = spread.withColumn("kind", each).select("doc_id", "n_tokens", "grp", "kind.container", "kind.capacity")
    # little data, much work: a fixed number of partitions, which adaptive execution leaves apart
    rows = rows.repartition(max(1, -(-groups * len(listed) // GROUPS_PER_TASK)), "container", "capacity", "grp")
    return rows.groupBy("container", "capacity", "grp").applyInArrow(_pack_group, _OUT)


def pack_documents(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`pack_items` of the texts of documents, sized in tokens of the vocabulary at `path`."""
    return pack_items(cut(token_counts(documents, path)), containers)


def packing_report(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`(container, capacity, n_bins, n_least, fill)`; n_least is the total size over the capacity, rounded up."""
    packed = pack_documents(documents, containers, path).where("n_tokens > 0")
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("n_tokens").alias("used"))
    return bins.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.ceil(F.sum("used") / F.col("capacity")).alias("n_least"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * F.col("capacity")), 4).alias("fill"),
    )
