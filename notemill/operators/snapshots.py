"""What changed between full snapshots.

Method: rows are reduced to compact arrays of key hashes, row hashes and ordinals, spread over hash
buckets; each bucket is sorted in numpy and compared by searchsorted; full values are retrieved only for the
keys that differ, which filter the rows before these move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import BROADCAST_ROWS, cut, few

ADDED, REMOVED, CHANGED = 0, 1, 2
#: Rows of one bucket, about 60 bytes each while it is compared.
ROWS_PER_BUCKET = 500_000

_DIFF = "k1 long, k2 long, n int, kind int"


def _key_ids(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Dense ids of the 128-bit keys. The second half is only looked at where the first half collides."""
    order = np.lexsort((k2, k1))
    new = np.empty(len(order), bool)
    if len(order):
        new[0] = False
        new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    return ids


def diff_bucket(k1: np.ndarray, k2: np.ndarray, row: np.ndarray, loaded: np.ndarray, n: np.ndarray, last: np.ndarray):
    """`(k1, k2, n, kind)` arrays of one bucket; n is the ordinal of the snapshot whose row holds the values.

    `n` counts a vault's snapshots from 0, of which the first is compared with none, and `last` is its highest. Of several rows with one key and
    snapshot the latest loaded holds (on a tie the greater row hash).
    """
    if not len(n):
        return k1, k2, n, np.zeros(0, np.int32)
    ids = _key_ids(k1, k2)
    width = int(last.max()) + 2
    code = ids * width + n  # one code for a key in a snapshot; +1 is the key in the next snapshot
    order = np.lexsort((row, loaded, code))
    code = code[order]
    keep = np.append(code[1:] != code[:-1], True)
    order, code = order[keep], code[keep]
    h, n, last = row[order], n[order], last[order]

    def place(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return at, code[at] == wanted

    before, had = place(code - 1)
    had &= n > 0
    _, has = place(code + 1)
    changed = had & (h[before] != h)
    gone = ~has & (n < last)
    parts = [(np.flatnonzero(~had & (n > 0)), ADDED), (np.flatnonzero(changed), CHANGED), (np.flatnonzero(gone), REMOVED)]
    at = np.concatenate([p for p, _ in parts])
    kind = np.concatenate([np.full(len(p), k, np.int32) for p, k in parts])
    return k1[order[at]], k2[order[at]], n[at], kind


def _compare(t: pa.Table) -> pa.Table:
    col = lambda c: t.column(c).to_numpy()
    k1, k2, n, kind = diff_bucket(col("k1"), col("k2"), col("row"), col("loaded"), col("n").astype(np.int64), col("last").astype(np.int64))
    return pa.table({"k1": k1, "k2": k2, "n": n.astype(np.int32), "kind": kind})


def snapshot_order(files: DataFrame) -> DataFrame:
    """`(vault, snap, n, last, next_snap)`: a vault's snapshots are the snap values it has rows for."""
    w = Window.partitionBy("vault").orderBy("snap")
    every = Window.partitionBy("vault")
    return (
        files.where(F.col("snap").isNotNull())
        .select("vault", "snap")
        .distinct()
        .select(
            "vault",
            "snap",
            (F.row_number().over(w) - 1).alias("n"),
            (F.count(F.lit(1)).over(every) - 1).cast("int").alias("last"),
            F.lead("snap").over(w).alias("next_snap"),
        )
    )


def snapshot_changes(files: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, broadcast_keys: int = BROADCAST_ROWS) -> DataFrame:
    """`(vault, snap, path, change_kind)`: added, removed and changed paths between consecutive snapshots.

    snap is the later snapshot; a vault's first one is compared with none and gives no row. Paths compare exactly. Two
    nulls are equal, a null and a value differ, in path and vault too. Rows without a snap belong to no
    snapshot and are left out. A null loaded_at is the earliest. `rows_per_bucket` and `broadcast_keys` change no row. Buckets are of a hash of the key, so a
    vault that holds a third of all rows spreads over all of them.
    """
    order = few(cut(snapshot_order(files)), broadcast_keys)  # a row per vault and snapshot
    o = order.select(F.col("vault").alias("o_vault"), F.col("snap").alias("o_snap"), "n", "last", "next_snap")
    keyed = files.where(F.col("snap").isNotNull()).select(
        "vault",
        "snap",
        "path",
        F.xxhash64("vault", "path", F.col("vault").isNull(), F.col("path").isNull()).alias("k1"),
        F.xxhash64(F.lit(0x5BD1), F.col("path").isNull(), "path", "vault", F.col("vault").isNull()).alias("k2"),
        F.xxhash64("mtime_ms", F.col("mtime_ms").isNull(), "size", F.col("size").isNull()).alias("row"),
        F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**63))).alias("loaded"),
    )
    keyed = keyed.join(o, F.col("vault").eqNullSafe(F.col("o_vault")) & (F.col("snap") == F.col("o_snap")))
    buckets = max(1, -(-files.count() // rows_per_bucket))  # a count from Parquet's footers
    diffs = (
        keyed.select("k1", "k2", "row", "loaded", F.col("n").cast("int"), "last", F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"))
        .groupBy("bucket")
        .applyInArrow(_compare, _DIFF)
    )
    diffs = few(cut(diffs), broadcast_keys)
    full = keyed.select("k1", "k2", "n", "vault", "snap", "path", "next_snap")
    kind = F.element_at(F.array(F.lit("added"), F.lit("removed"), F.lit("changed")), F.col("kind") + 1)
    found = full.join(diffs, ["k1", "k2", "n"]).select(
        "vault", F.when(F.col("kind") == REMOVED, F.col("next_snap")).otherwise(F.col("snap")).alias("snap"), "path", kind.alias("change_kind")
    )
    return found.distinct()  # of keys delivered more than once


def snapshot_summary(files: DataFrame) -> DataFrame:
    """`(vault, snap, added, removed, changed)` counts per vault and later snapshot."""
    n = lambda k: F.count_if(F.col("change_kind") == k).alias(k)
    return snapshot_changes(files).groupBy("vault", "snap").agg(n("added"), n("removed"), n("changed"))
