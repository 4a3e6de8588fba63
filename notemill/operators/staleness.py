"""Whether an index still describes its vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(scanned: DataFrame, indexed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`(keys..., state)`: added, changed or removed, by a full outer join on `keys` (path unless given).

    A file has changed where mtime or size differ; two nulls are equal.
    """
    keys = keys or ["path"]
    a = scanned.select(*keys, F.col("mtime_ms").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("in1"))
    b = indexed.select(*keys, F.col("mtime_ms").alias("m2"), F.col("size").alias("s2"), F.lit(True).alias("in2"))
    same = F.col("m1").eqNullSafe(F.col("m2")) & F.col("s1").eqNullSafe(F.col("s2"))
    state = F.when(F.col("in2").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~same, "changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state")).where(F.col("state").isNotNull())


def staleness(scanned: DataFrame, indexed: DataFrame, by: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """`(by..., stale, added, changed, removed)`; groups without a difference have no row where `by` is given."""
    n = lambda k: F.count_if(F.col("state") == k).alias(k)
    d = differences(scanned, indexed, keys)
    out = d.groupBy(*(by or [])).agg(n("added"), n("changed"), n("removed"))
    stale = (F.col("added") + F.col("changed") + F.col("removed") > 0).alias("stale")
    return out.select(*(by or []), stale, "added", "changed", "removed")
