"""Orphan references and snapshot changes against brute force, with nulls, ties, repeated rows, empty tables, odd columns."""

import datetime as dt
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from .conftest import NOTES
from pyspark.sql import functions as F

from notemill import reference_queries
from notemill.common import block_pairs, salted_join
from notemill.operators import orphans, snapshots

UTC = dt.timezone.utc
EDITS = "edit_id long, vault string, path string, line int, before string, after string, ts timestamp, received_at timestamp"
FILES = "vault string, snap string, path string, mtime_ms long, size long, loaded_at timestamp"


def at(y, m, d=5):
    return dt.datetime(y, m, d, tzinfo=UTC)


def ms(y, m):
    return int(at(y, m).timestamp() * 1000)


def note(i, vault, path, title=None, aliases=None, links=None, month=(2025, 3), added=(2025, 1), removed=None):
    return (i, vault, path, title, aliases, None, links, None, ms(*month), None, None, None, None, at(*added) if added else None, at(*removed) if removed else None)


def test_orphans(spark):
    notes = spark.createDataFrame(
        [
            note(1, "v", "a/One.md", "Title One", ["Alias", None], ["one", " TWO.md ", "nowhere", "", None, " ", "x/one", "title one", "alias", "later", "gone", "a/one"]),
            note(2, "v", "two.md", None, None, None),
            note(3, "v", "later.md", added=(2025, 4)),
            note(4, "v", "gone.md", added=(2025, 1), removed=(2025, 3)),
            note(5, "w", "other.md", links=["one", "one"], month=(2025, 5)),
            note(6, None, "nov.md", links=["nov"]),
            note(7, "v", None, None, [], []),
        ],
        NOTES,
    )
    edits = spark.createDataFrame(
        [
            (1, "v", " A/one.MD\t", 1, None, None, at(2025, 3), None),
            (1, "v", " A/one.MD\t", 1, None, None, at(2025, 3), None),
            (2, "v", "One", None, None, None, at(2025, 3), None),
            (3, "v", None, None, None, None, at(2025, 3), None),
            (4, "v", "gone.md", None, None, None, at(2025, 2), None),
            (5, "v", "gone.md", None, None, None, at(2025, 3), None),
            (6, "v", "", None, None, None, at(2025, 3), None),
        ],
        EDITS,
    ).withColumn("name", F.lit("clash")).withColumn("target", F.lit(1))
    got = {tuple(r) for r in orphans.orphan_references(notes, edits).collect()}
    assert got == {
        ("notes", "2025-03", 1, "nowhere"), ("notes", "2025-03", 1, "later"), ("notes", "2025-03", 1, "gone"),
        ("notes", "2025-05", 5, "one"), ("notes", "2025-03", 6, "nov"),
        ("edits", "2025-03", 2, "One"), ("edits", "2025-03", 5, "gone.md"), ("edits", "2025-03", 6, ""),
    }
    rep = {(r["tbl"], r["ym"]): (r["n_refs"], r["n_orphans"]) for r in orphans.orphan_report(notes, edits).collect()}
    assert rep == {("notes", "2025-03"): (10, 4), ("notes", "2025-05"): (2, 2), ("edits", "2025-02"): (1, 0), ("edits", "2025-03"): (5, 3)}
    none = orphans.orphan_references(notes.limit(0), edits.limit(0))
    assert none.columns == ["tbl", "ym", "row_id", "target"] and none.count() == 0


def test_months_ignore_the_session_zone(spark):
    edits = spark.createDataFrame([(1, "v", "x", None, None, None, dt.datetime(2025, 2, 28, 23, 30, tzinfo=UTC), None)], EDITS)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert orphans.edit_references(edits).first()["ym"] == "2025-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_salted_join_keeps_every_row(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    keyed = big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 'k3'")
    want = big.where("k <> 'k3'").count()
    assert salted_join(big, keyed, ["k"], "n", heavy_rows=100).count() == want
    left = salted_join(big, keyed, ["k"], "n", how="left", heavy_rows=100)
    assert left.count() == 3000 and left.where("n is null").count() == 3000 - want


def test_more_heavy_keys_than_the_list_holds(spark):
    big = spark.range(4000).select("id", F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("k"))
    keyed = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    twice = keyed.union(keyed)  # more than one row a key
    for most in (0, 2, 100):
        assert salted_join(big, twice, ["k"], "n", heavy_rows=50, heavy_keys=most).count() == 8000


def test_block_pairs_lose_no_pair(spark):
    members = spark.createDataFrame([(g, i) for g, n in ((1, 60), (2, 9), (3, 1)) for i in range(g * 100, g * 100 + n)], "grp long, id long")
    links = spark.createDataFrame([(1, 1, 60, 60), (1, 2, 60, 9), (3, 3, 1, 1)], "a long, b long, n_a long, n_b long")
    want = {(i, j) for i in range(100, 160) for j in range(100, 160) if i < j} | {(i, j) for i in range(100, 160) for j in range(200, 209)}
    for block in (7, 1000):
        got = [(r["a_id"], r["b_id"]) for r in block_pairs(links, members, block).collect() if r["a_id"] != r["b_id"]]
        assert {(min(p), max(p)) for p in got} == want
    assert block_pairs(links.limit(0), members, 7).count() == 0


def brute(rows, first=False):
    """Changes between consecutive snapshots; `first` compares a vault's first one with nothing held."""
    held = {}
    for v, s, p, m, z, t in rows:
        if s is not None and ((v, s, p) not in held or (t or at(1970, 1)) > held[v, s, p][1]):
            held[v, s, p] = ((m, z), t or at(1970, 1))
    by = defaultdict(lambda: defaultdict(dict))
    for (v, s, p), (x, _) in held.items():
        by[v][s][p] = x
    out = set()
    for v, snaps in by.items():
        order = sorted(snaps)
        before = {} if first else snaps[order[0]]
        for s in order if first else order[1:]:
            now = snaps[s]
            out |= {(v, s, p, "added") for p in now.keys() - before.keys()} | {(v, s, p, "removed") for p in before.keys() - now.keys()}
            out |= {(v, s, p, "changed") for p in now.keys() & before.keys() if now[p] != before[p]}
            before = now
    return out


def test_snapshots_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for v in ("a", "b", None):
        for s in ("2025-01", "2025-02", "2025-04"):
            if v == "b" and s == "2025-02":
                continue
            for p in [f"p{i}" for i in range(40)] + [None]:
                if rnd.random() < 0.8:
                    rows.append((v, s, p, rnd.choice([1, 2, None]), rnd.choice([5, None]), at(2025, 5, rnd.randint(1, 9))))
                    if rnd.random() < 0.2:
                        rows.append(rows[-1])
                    if rnd.random() < 0.2:
                        rows.append((v, s, p, 9, 9, at(2025, 6, rnd.randint(1, 9))))
    rows.append(("a", None, "p1", 1, 1, at(2025, 5)))
    df = spark.createDataFrame(rows, FILES).withColumn("n", F.lit("clash")).withColumn("k1", F.lit(1))
    want = brute(rows)
    assert not any(s == "2025-01" for _, s, _, _ in want) and ("b", "2025-04") in {(v, s) for v, s, _, _ in want}
    for per, keys in ((500_000, 1_000_000), (20, 0)):
        got = [tuple(r) for r in snapshots.snapshot_changes(df, per, keys).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    first = df.where("snap = '2025-01'")
    assert snapshots.snapshot_changes(first).count() == 0 and snapshots.snapshot_summary(first).count() == 0
    assert snapshots.snapshot_changes(df.limit(0)).count() == 0


def test_staleness_and_manifests_of_every_own_snapshot(spark):
    rnd = random.Random(8)
    snaps = {"all": ["2025-04", "2025-05", "2025-06"], "no may": ["2025-03", "2025-04", "2025-06"], "no june": ["2025-04", "2025-05"]}
    rows = [(v, s, f"p{i}", rnd.choice([1, 2]), rnd.choice([5, None]), at(2025, 7)) for v, ss in snaps.items() for s in ss for i in range(20) if rnd.random() < 0.7]
    rows += [(*r[:3], 9, 9, at(2025, 8)) for r in rows[::7]]
    df = spark.createDataFrame(rows, FILES)
    want = Counter((v, s, k) for v, s, _, k in brute(rows, first=True))
    got = {(r["vault"], r["snap"]): r for r in reference_queries._staleness_snaps(df).collect()}
    assert got.keys() == {(v, s) for v, ss in snaps.items() for s in ss}
    assert all(r["stale"] and r[k] == want[v, s, k] for (v, s), r in got.items() for k in ("added", "changed", "removed"))
    assert got["no may", "2025-06"]["added"] < len({r[2] for r in rows if r[:2] == ("no may", "2025-06")})
    held = {r[:3]: r for r in rows}
    for r in reference_queries._manifest_hash_snaps(df).collect():
        lines = [f"{p} {z} {m}\n" for (v, s, p), (*_, m, z, _) in sorted(held.items()) if (v, s) == (r["vault"], r["snap"]) and z is not None]
        assert r["manifest_hash"] == hashlib.sha256("".join(lines).encode()).hexdigest()
    assert {"staleness_snaps", "manifest_hash_snaps"} <= reference_queries.QUERIES.keys()


def test_key_ids_survive_a_collision_of_the_first_half():
    ids = snapshots._key_ids(np.array([7, 7, 7, 1]), np.array([1, 2, 1, 0]))
    assert ids[0] == ids[2] != ids[1] and len(set(ids)) == 3
