"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`(id, component)` for every end of an edge; component is the least id of the component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes, which takes a
    number of rounds logarithmic in the size of the graph; a node's neighbours are never gathered in one
    row. Each round is materialised in the shared checkpoint folder; only a count and a checksum reach
    the driver. Loops (a = b) count as nodes.
    """
    ids = lambda x, y: edges.select(F.col(x).alias("u"), F.col(y).alias("v"))
    nodes = ids(a, b).union(ids(b, a)).select(F.col("u").alias("id")).distinct()
    e = ids(a, b).where(F.col("u") != F.col("v"))
    seen = None
    while True:
        # large star: every neighbour greater than u links to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours link to the least of them
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = down.join(low, "u")
        e = (
            pairs.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    out = nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
    return out.select("id", F.coalesce("component", "id").alias("component"))
