"""Helpers that several operators share: text normalisation, months, skew-proof joins, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NotemillError

#: Every code point with Unicode's White_Space property (fixed values). Spark's trim strips only U+0020.
WHITE = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def trimmed(c: Column | str) -> Column:
    """`c` without leading and trailing Unicode white space."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def normalised(c: Column | str) -> Column:
    """`c` trimmed of Unicode white space and lower-cased; null stays null."""
    return F.lower(trimmed(c))


def month_of_millis(c: Column | str) -> Column:
    """UTC calendar month `yyyy-MM` of epoch milliseconds, whatever the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    day = F.floor(c / F.lit(86_400_000)).cast("int")
    return F.substring(F.date_from_unix_date(day).cast("string"), 1, 7)


def month_of_timestamp(c: Column | str) -> Column:
    """UTC calendar month `yyyy-MM` of a timestamp, whatever the session's time zone."""
    return month_of_millis(F.floor(F.unix_micros(c) / F.lit(1000)))


def last_segment(c: Column) -> Column:
    """What follows the last `/`."""
    return F.substring_index(c, "/", -1)


def stem_of(c: Column) -> Column:
    """The last `/` segment without its last `.` and what follows."""
    seg = last_segment(c)
    dot = F.length(seg) - F.length(F.substring_index(seg, ".", -1))
    return F.when(dot > 0, F.substring(seg, F.lit(1), dot - 1)).otherwise(seg)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_lengths(arr: Column) -> Column:
    """`array<struct<item, n>>`: each distinct non-null element of an array and how often it occurs.

    Sorts inside the row and takes the lengths of runs, so counting within a record needs no shuffle
    and n log n time. Null arrays give an empty array.
    """
    present = F.array_sort(F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda x: x.isNotNull()))

    def counted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))),
        )
        run = lambda st: F.transform(
            st, lambda p, j: F.struct(F.get(s, p).alias("item"), (F.coalesce(F.get(st, j + 1), n) - p).cast("int").alias("n"))
        )
        return let(starts, run)

    return let(present, counted)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share; set here where the context has none yet.

    Where the session names none, a temporary one will do on a local master and is refused on any other.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise NotemillError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="notemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget its lineage, so the loss of an executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: like `cut`, for what is read again by some of its columns."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows that `few` lets be broadcast. Callers pass rows of fixed width, so this bounds the bytes.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, materialised before, with a broadcast hint if it has at most `rows` rows; else any join will shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than there are; large inputs stay as they are read.

    For operators whose work per row outweighs moving the row.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


#: Most keys that a heavy list may hold, 16 bytes each: what is broadcast stays below a megabyte at any data size,
#: and a key outside the list has less than 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 50_000


def salted_join(
    big: DataFrame,
    keyed: DataFrame,
    keys: list[str],
    weight: str,
    how: str = "inner",
    heavy_rows: int = 200_000,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """Join `big` with `keyed` (column `weight` says how many rows of `big` have the key), skew-proof.

    The `heavy_keys` heaviest keys above `heavy_rows` rows are broadcast as (hash of the key, salts), a list whose
    size does not grow with the data. Rows of `big` with such a key get one of the salts, the key's rows
    in `keyed` are repeated for each salt, and both sides meet in one shuffle join on (keys, salt), in
    which no key holds more than about `heavy_rows` rows of `big`. Keys whose hashes collide share their salts, on both
    sides. The salt is a hash of the whole row, so a task that runs again after a loss gives the same rows. Keys
    compare null-safe; `how` is inner or left.
    """
    heavy = (
        keyed.where(F.col(weight) > heavy_rows)
        .groupBy(F.xxhash64(*keys).alias("__h"))
        .agg(F.max(F.ceil(F.col(weight) / heavy_rows)).cast("int").alias("__salts"))
        .orderBy(F.desc("__salts"), "__h")
        .limit(heavy_keys)
    )

    def with_salts(df: DataFrame) -> DataFrame:
        return df.withColumn("__h", F.xxhash64(*keys)).join(F.broadcast(heavy), "__h", "left").drop("__h")

    left = with_salts(big).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("__salts")).cast("int"), F.lit(0)))
    right = with_salts(keyed).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
    right = right.drop("__salts").select(*(F.col(c).alias(f"__r_{c}") for c in [*keyed.columns, "__salt"]))
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in [*keys, "__salt"]]
    out = left.join(right, on, how)
    rest = [F.col(f"__r_{c}").alias(c) for c in keyed.columns if c not in keys]
    return out.select(*big.columns, *rest)


def block_pairs(links: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Pairs of members of linked groups, skew-proof: `links` `(a, b, n_a, n_b)`, a <= b, with the sizes of both groups.

    `members` has `grp` and any other columns, which come out as `a_...` and `b_...`. A group of n members is cut into
    n / `block` blocks by a hash; every pair of blocks of a link is a join group of its own, so a group that holds a
    third of all rows is spread over many tasks. Of a link of a group with itself each unordered pair of rows comes
    out at least once, a row with itself too; nothing is capped or dropped.
    """
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    start = F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0)
    cells = links.select("a", "b", F.explode(F.sequence(F.lit(0), blocks("n_a") - 1)).alias("i"), blocks("n_b").alias("nb"), "n_a", "n_b")
    cells = cells.select("a", "b", "n_a", "n_b", "i", F.explode(F.sequence(start, F.col("nb") - 1)).alias("j"))
    sizes = links.select(F.col("a").alias("grp"), F.col("n_a").alias("n")).union(links.select("b", "n_b")).distinct()
    placed = salted_join(members, sizes, ["grp"], "n")
    placed = placed.withColumn("own", F.pmod(F.xxhash64(*members.columns), blocks("n")).cast("int"))

    def end(e: str, at: str) -> DataFrame:
        return placed.select(F.col("grp").alias(e), F.col("own").alias(at), *(F.col(c).alias(f"{e}_{c}") for c in members.columns if c != "grp"))

    return cells.join(end("a", "i"), ["a", "i"]).join(end("b", "j"), ["b", "j"]).drop("i", "j", "n_a", "n_b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
